"""Text functions of the dataflow operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The log-level pattern (greedy, so the last tag of a line counts), the level
# for lines without a tag, the longest accepted line in bytes, the white-space class.
LEVEL_PATTERN = r".*\[(DEBUG|INFO|WARN|ERROR)\].*"
UNKNOWN_LEVEL = "UNKNOWN"
MAX_LINE_BYTES = 512
WHITE_SPACE = r"[ \t\n\x0B\f\r]"
WHITE_SPACE_CHARS = " \t\n\x0b\f\r"


def log_level(line: Column) -> Column:
    """Level named by the last tag on the line, UNKNOWN without one."""
    found = F.regexp_extract(line, LEVEL_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(UNKNOWN_LEVEL))


def tokens(text: Column) -> Column:
    """Cut at every single white-space char: inner empty tokens stay, trailing ones go.

    Trailing empty tokens come from trailing white space, so that is cut off first. A text without
    any white space is one token, also when it is empty.
    """
    kept = F.rtrim(text, F.lit(WHITE_SPACE_CHARS))
    only_space = (kept == "") & (text != "")
    return F.when(only_space, F.array().cast("array<string>")).otherwise(F.split(kept, WHITE_SPACE, -1))


def framed_lines(text: Column, separator: str = "\n") -> Column:
    """Lines of a text; the last one may lack its terminator, '\\r' stays in the line."""
    parts = F.split(text, separator, -1)
    ends_clean = F.element_at(parts, -1) == ""
    return F.when(ends_clean, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def too_long(line: Column, max_bytes: int = MAX_LINE_BYTES) -> Column:
    """True where the line does not fit the frame limit."""
    return F.octet_length(line) > max_bytes

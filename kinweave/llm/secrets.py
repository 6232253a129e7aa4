"""Secret scan: three fixed patterns, and a token-efficiency test for other random strings.

Random strings need many tokens: a run of ``[A-Za-z0-9+/_=-]`` with a letter and a digit that takes
one token per ``max_ratio`` characters or fewer under a tiktoken vocabulary counts as a secret, unless
it has the form of a known digest or identifier (hex digests of the usual lengths, UUIDs, dates). Letters
alone have to be longer and denser in tokens, as no word of a natural language is. Where a whole run does not
count, its parts between separators do by the same test, and then its densest stretch of tokens, so readable
text around a secret does not hide it.

Runs and hex strings are found on the bytes of a whole batch; a regular expression then reads only the
texts that can match, in whole. Nulls and empty texts have no secrets; repeated rows are scanned each.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rawtext import slices, text_buffer

#: Patterns of the base kinds, in their order (fixed values).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Forms that look random and are no secrets: digests by length, UUIDs, dates and times, numbered names (fixed values).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d{4}-\d{2}-\d{2}(T\d{2,6}Z?)?|[A-Za-z]+([_/-]\d{1,4}){3,}"
)
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
SEPARATOR = re.compile(r"[/_=+-]+")
#: Runs of letters alone: least length, characters per token; stretches inside a run: least length, classes in it.
MIN_LETTERS, LETTER_RATIO = 20, 1.9
MIN_STRETCH, STRETCH_CLASSES = 24, tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]")))
MIN_RUN, MIN_HEX, MIN_ACCESS, MIN_VALUE = 16, 24, 20, 6
#: How byte-level BPE vocabularies of this family cut a text first (fixed value).
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

SPANS = "array<struct<kind:string,start:bigint,end:bigint,secret:string>>"
_encodings: dict[str, object] = {}


def load_ranks(path: str) -> bytes:
    """The vocabulary file, read by the driver and sent to the tasks (under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def _encoding(ranks: bytes):
    """One encoder per Python worker."""
    import tiktoken

    key = hashlib.md5(ranks).hexdigest()
    if key not in _encodings:
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        _encodings[key] = tiktoken.Encoding(
            key, pat_str=PRE_TOKENS, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}
        )
    return _encodings[key]


def known_form(run: str) -> bool:
    """A digest or an identifier by its form."""
    return bool(len(run) in DIGEST_LENGTHS and ALL_HEX.fullmatch(run) or IDENTIFIER.fullmatch(run))


def looks_random(run: str, encoding, max_ratio: float) -> bool:
    """True for a run of few characters per token that is no known digest or identifier."""
    if len(run) < MIN_RUN or not re.search(r"[A-Za-z]", run) or known_form(run):
        return False
    if not re.search(r"[0-9]", run):
        if len(run) < MIN_LETTERS or not run.isalpha():
            return False
        max_ratio = min(max_ratio, LETTER_RATIO)
    return len(run) <= max_ratio * len(encoding.encode_ordinary(run))


def random_parts(run: str, encoding, max_ratio: float) -> list[tuple[int, int]]:
    """Ranges of a run that look random: the whole, else parts between separators, else the densest stretch."""
    if known_form(run):
        return []
    cuts = [0, *(x for m in SEPARATOR.finditer(run) for x in m.span()), len(run)]
    parts = list(zip(cuts[::2], cuts[1::2]))
    # a digest among the parts would lower the ratio of the whole
    known = any(known_form(run[a:b]) for a, b in parts)
    if not known and looks_random(run, encoding, max_ratio):
        return [(0, len(run))]
    found = [(a, b) for a, b in parts if len(parts) > 1 and looks_random(run[a:b], encoding, max_ratio)]
    if found or len(run) < MIN_STRETCH or known:
        return found
    if not all(letters.search(run) for letters in STRETCH_CLASSES):
        return []
    a, b = _densest(run, encoding, max_ratio)
    own = run[a:b]
    dense = b - a >= MIN_STRETCH and all(letters.search(own) for letters in STRETCH_CLASSES)
    return [(a, b)] if dense and not known_form(own) else []


def _densest(run: str, encoding, max_ratio: float) -> tuple[int, int]:
    """The range of tokens that has most tokens beyond one per ``max_ratio`` characters."""
    at, total, start, best = 0, 0.0, 0, (0.0, 0, 0)
    for token in encoding.encode_ordinary(run):
        size = len(encoding.decode_single_token_bytes(token))
        if total <= 0:
            total, start = 0.0, at
        at += size
        total += max_ratio - size
        best = max(best, (total, start, at), key=lambda x: x[0])
    return best[1:]


def secrets_of(text: str, encoding, max_ratio: float) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, string) of one text by start, then kind; a random run inside another is left out."""
    found = [("assign", *m.span(), m[0]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    base = [x[1:3] for x in found]
    for m in RUN.finditer(text):
        for low, high in random_parts(m[0], encoding, max_ratio) if len(m[0]) >= MIN_RUN else ():
            start, end = m.start() + low, m.start() + high
            if not any(a <= start and end <= b for a, b in base):
                found.append(("random", start, end, text[start:end]))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _byte_set(letters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(letters)] = True
    return table


_DIGITS = b"0123456789"
_IN_HEX = _byte_set(_DIGITS + b"abcdef")
_IN_RUN = _byte_set(_DIGITS + b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-")
_IS_DIGIT = _byte_set(_DIGITS)
_IN_LETTERS = _byte_set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def _rows_with_run(inside: np.ndarray, least: int, offsets: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Rows that a run of at least so many bytes touches; of runs that hold a wanted byte, if given."""
    gaps = np.flatnonzero(~np.concatenate([[False], inside, [False]]))
    long = np.flatnonzero(np.diff(gaps) > least)
    starts, ends = gaps[long], gaps[long + 1] - 1
    if wanted is not None:
        counts = np.concatenate([[0], np.cumsum(wanted)])
        keep = counts[ends] > counts[starts]
        starts, ends = starts[keep], ends[keep]
    first = np.searchsorted(offsets, starts, "right") - 1
    last = np.searchsorted(offsets, ends - 1, "right") - 1
    touched = np.zeros(len(offsets), np.int64)
    np.add.at(touched, first, 1)
    np.add.at(touched, np.minimum(last + 1, len(offsets) - 1), -1)
    return np.cumsum(touched)[:-1] > 0


def _candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a secret; no row with one is left out."""
    rows = _rows_with_run(_IN_HEX[data], MIN_HEX, offsets)
    rows |= _rows_with_run(_IN_RUN[data], MIN_RUN, offsets, _IS_DIGIT[data])
    rows |= _rows_with_run(_IN_LETTERS[data], MIN_LETTERS, offsets)
    plain, lower = data.tobytes(), data.tobytes().lower()
    for where, needles in ((plain, (b"AKIA",)), (lower, _WORDS)):
        for needle in needles:
            at = where.find(needle)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                rows[row] = True
                at = where.find(needle, int(offsets[row + 1]))
    return rows


def find_secrets(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.2
) -> DataFrame:
    """(id, secrets) for every row, secrets as structs of kind, start, end (code points) and string.

    ``vocabulary`` is the path of a tiktoken rank file. ``max_ratio``: characters per token up to which
    a run counts as random. Null text has an empty list; a null id is kept.
    """
    sent = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent.value)
        for part in slices(batches, "text", 4_000_000):
            data, offsets = text_buffer(part.column("text"))
            rows = _candidates(data, offsets)
            raw = data.tobytes()
            found = [
                [dict(kind=k, start=a, end=b, secret=s) for k, a, b, s in
                 secrets_of(raw[offsets[i]: offsets[i + 1]].decode(), encoding, max_ratio)] if rows[i] else []
                for i in range(part.num_rows)
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, kind)], ["id", "secrets"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, secrets {SPANS}").withColumnRenamed(
        "id", id_col
    )


def joined(secrets, kinds=KINDS):
    """kind:start:end of the secrets of these kinds, comma-joined in their order."""
    chosen = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_report(df: DataFrame, vocabulary: str, max_ratio: float = 2.2) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans, one row per document."""
    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return find_secrets(df, vocabulary, max_ratio=max_ratio).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("secrets"), KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"), count("random"),
    )

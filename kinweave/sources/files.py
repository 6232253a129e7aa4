"""Text file source with a frame limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import MAX_LINE_BYTES, framed_lines, too_long


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of text files cut at '\\n' only (S11); files are read in splits, not whole."""
    reader = spark.readStream if streaming else spark.read
    return reader.option("lineSep", "\n").text(path).withColumnRenamed("value", "line")


def split_by_length(lines: DataFrame, max_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): lines within the frame limit, and those beyond it."""
    long = too_long(F.col("line"), max_bytes)
    return lines.filter(~long), lines.filter(long)


def lines_of_texts(texts: DataFrame, key: str, text: str = "text", max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """The same framing for a table of whole texts: (key, line_no, line, n_bytes, rejected)."""
    return texts.select(key, F.posexplode(framed_lines(F.col(text))).alias("line_no", "line")).select(
        key, "line_no", "line", F.octet_length("line").alias("n_bytes"),
        too_long(F.col("line"), max_bytes).alias("rejected"),
    )

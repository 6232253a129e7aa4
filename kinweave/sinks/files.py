"""File and callback sinks (K2-K5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions.text import log_level
from ..streaming.keyed import GatedStream


def write_text(df: DataFrame, column: str, path: str) -> int:
    """One element per line; returns the bytes of the elements themselves (K3)."""
    seen = Observation()
    text = df.select(F.col(column).cast("string").alias("value"))
    text.observe(seen, F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes")).write.text(path)
    return seen.get["bytes"]


def write_by_level(lines: DataFrame, path: str, line: str = "line") -> None:
    """Lines into one directory per log level (K4); a level without lines has none.

    No shuffle: every task writes its own file per level, so a dominant level is no bottleneck.
    """
    lines.select(F.col(line).alias("value"), log_level(F.col(line)).alias("level")).write.partitionBy("level").text(path)


def print_rows(stream: DataFrame, name: str):
    """Print a stream to the console (K2)."""
    return stream.writeStream.format("console").queryName(name).option("truncate", "false").start()


def for_each_batch(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str | None = None,
    output_mode: str = "append",
    **trigger,
):
    """Hand every micro-batch to a function (K5)."""
    writer = stream.writeStream.foreachBatch(step).outputMode(output_mode).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(**trigger) if trigger else writer).start()


def batch_table(stream: DataFrame | GatedStream, path: str, checkpoint: str, **options):
    """A table with one partition per micro-batch; a batch run again overwrites its own (K1, K5).

    Of a gated stream these are the rows that pass; its gates are kept in the checkpoint folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if isinstance(stream, GatedStream):
            stream.write(batch, batch_id, f"{path}/batch={batch_id}", f"{checkpoint}/gates")
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return for_each_batch(stream.rows if isinstance(stream, GatedStream) else stream, write, checkpoint, **options)

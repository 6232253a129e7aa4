"""Keys that are started and stopped inside one stream.

A gate per key is open or closed; marks move it, rows pass while it is open. A mark acts on the rows after
its own position, so the row that ends a take-while still passes. Marks and rows of a micro-batch meet in
the order of their positions, and a batch starts from where the earlier ones left each key: what comes late
acts on arrival.

A gated stream is written by ``batch_table``, which applies the gates to every micro-batch with the batch
operators. Gates are a table beside the query's checkpoint, one partition per micro-batch: a batch writes the
gates it moved and reads those of earlier batches, so one that died half-way is simply run again. For a
take-while one minimum per key is enough. Else the last mark before a row is found in position chunks, so a
key with a third of all rows is spread over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators import ordered
from ..session import delete

SALTS = 16
#: Every so many micro-batches the gates of all keys are written once more, which bounds what is read.
COMPACT_EVERY = 50


@dataclass
class GatedStream:
    """A stream, and how its rows move and pass the gates of their keys; ``final`` gates never open again.

    ``mark`` is null for rows that leave the gate alone. A position chunk has ``ROWS_PER_CHUNK`` rows shared by
    ``salts``.
    """

    rows: DataFrame
    keys: Sequence[str]
    order: Sequence[str]
    mark: Column
    passes: Column
    final: bool
    salts: int = SALTS

    def write(self, batch: DataFrame, batch_id: int, path: str, folder: str) -> None:
        """Write the rows of a micro-batch that pass to ``path``, and the gates it moved to a partition of ``folder``."""
        batch = batch.persist()
        try:
            marked = batch.select(
                # one column, so that null keys meet
                F.struct(*[F.col(key).alias(f"k{i}") for i, key in enumerate(self.keys)]).alias("_key"),
                F.struct(*self.order).alias("_at"), F.col(self.order[0]).alias("_first"),
                self.mark.alias("_mark"), self.passes.alias("_passes"), F.struct(*batch.columns).alias("_row"),
            )
            before = self._before(marked.schema["_key"].dataType, batch, batch_id, folder)
            kept, moved = (self._taken if self.final else self._switched)(marked, before)
            if batch_id > 0 and batch_id % COMPACT_EVERY == 0:
                moved = moved.unionByName(before.join(moved, "_key", "left_anti"))
            moved.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
            kept.select("_row.*").write.mode("overwrite").parquet(path)
            floor, earlier = _floor(batch_id), _floor(batch_id - 1)
            delete(batch.sparkSession, *[f"{folder}/batch={i}" for i in range(earlier, floor)])
        finally:
            batch.unpersist()

    def _before(self, key: T.DataType, batch: DataFrame, batch_id: int, folder: str) -> DataFrame:
        """(_key, open) of the keys that earlier batches moved."""
        spark, gates = batch.sparkSession, T.StructType([T.StructField("_key", key), T.StructField("open", T.BooleanType())])
        if batch_id == 0:
            return spark.createDataFrame([], gates)
        folders = [f"{folder}/batch={i}" for i in range(_floor(batch_id), batch_id)]
        log = spark.read.schema(T.StructType([*gates.fields, T.StructField("batch", T.LongType())])).option("basePath", folder).parquet(*folders)
        return log.groupBy("_key").agg(F.max_by("open", "batch").alias("open"))

    def _taken(self, marked: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows up to the first closing mark of keys that are open yet, and the gates that close."""
        ends = marked.filter(~F.col("_mark")).groupBy("_key").agg(F.min("_at").alias("_end"))
        closed = before.filter(~F.col("open")).select("_key", F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"), F.lit(True).alias("_closed"))
        limits = ends.withColumn("_closed", F.lit(False)).unionByName(closed).groupBy("_key").agg(
            F.min("_end").alias("_end"), F.max("_closed").alias("_closed")
        )
        kept = marked.join(limits, "_key", "left").filter(
            "_passes and (_closed is null or (not _closed and _at <= _end))"
        )
        return kept, ends.select("_key", F.lit(False).alias("open"))

    def _switched(self, marked: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows whose last mark, of the batch or else of earlier ones, is open, and the last mark of each key."""
        moved = marked.filter(F.col("_mark").isNotNull()).groupBy("_key").agg(F.max_by("_mark", "_at").alias("open"))
        # of one position, rows come before marks
        placed = marked.withColumn("_is_mark", F.col("_mark").isNotNull())
        cuts, position = [], "_at"
        if isinstance(marked.schema["_first"].dataType, (T.NumericType, T.TimestampType)):
            placed, position = placed.withColumn("_place", F.coalesce(F.col("_first").cast("double"), F.lit(float("-inf")))), "_place"
            cuts = ordered.position_cuts(placed, "_place", max(ordered.ROWS_PER_CHUNK // self.salts, 1))
        told = ordered.previous_known(placed, ["_key"], ["_at", "_is_mark"], "_mark", "_told", cuts, position)
        kept = told.filter("_passes and coalesce(_told, true)") if before.isEmpty() else (
            told.filter("_passes").join(before, "_key", "left").filter("coalesce(_told, open, true)")
        )
        return kept, moved


def _floor(batch_id: int) -> int:
    """Earliest partition of gates that still matters to a batch."""
    return max((batch_id - 1) // COMPACT_EVERY * COMPACT_EVERY, 0)


def take_while_stream(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], predicate: Column, salts: int = SALTS
) -> GatedStream:
    """Per key: rows up to and including the first that fails the predicate, over all batches.

    Null fails like false. Needs no watermark: the state is one row per ended key.
    """
    ends = F.when(~F.coalesce(predicate, F.lit(False)), F.lit(False))
    return GatedStream(rows, keys, order, ends, F.lit(True), True, salts)


def switched_by_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], action: Column, salts: int = SALTS
) -> GatedStream:
    """Rows of the keys that run, in one query for all keys.

    ``action`` is null for a row of data, true for a message that starts its key and false for one that kills
    it. Keys run until they are killed; a killed key can be started again. Messages are not in the result. A control stream of its own is
    united with the rows before.
    """
    return GatedStream(rows, keys, order, action, action.isNull(), False, salts)

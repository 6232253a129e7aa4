"""State tables of the streaming engine: parquet, one partition per micro-batch.

A batch writes only its own partition and reads only those of earlier batches. Spark does not start
a batch before the previous one is done, so a batch that failed half-way is simply run again over
the same state and overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.routing import RECORD_ORDER
from ..schemas import CONTROL, GENERAL_ATTRIBUTES, REPORT
from ..session import delete

_TEXT, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()


def _fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


SCHEMAS: dict[str, T.StructType] = {
    # every control event ever seen; ``pos`` is where it took effect, ``event_pos`` what it said
    "control": T.StructType(
        CONTROL.fields + _fields(event_pos=_LONG, event_id=_TEXT, component=_TEXT, accepted=T.BooleanType())
    ),
    "members": T.StructType(_fields(
        family_id=_TEXT, version_seq=_INT, state=_TEXT, v_from=_LONG, v_to=_LONG, n_sons=_INT, son_ordinal=_INT,
        system_uuid=_TEXT, sensor_id=_TEXT, reports_id=_TEXT, data_offset=_LONG, same_source_ordinal=_INT,
        same_source_uuid=_TEXT, source_step=_INT, prev_family_id=_TEXT, prev_version_seq=_INT,
    )),
    # what is known of a son in a version; rows without position are seeds
    "sons": T.StructType(
        _fields(family_id=_TEXT, version_seq=_INT, system_uuid=_TEXT)
        + _fields(**dict(zip(RECORD_ORDER, (_LONG, _TEXT, _LONG, _INT))))
        + _fields(attributes=GENERAL_ATTRIBUTES)
    ),
    # the history that versions opened later read; stored by hashed topic, see ``topic_bucket``
    "reports": T.StructType(REPORT.fields + _fields(event_pos=_LONG)),
    # the greatest effective position so far, and how far positions are moved on
    "marks": T.StructType(_fields(high_water=_LONG, shift=_LONG)),
}
#: Folders of one batch's history.
TOPIC_BUCKETS = 64
# rows of a later batch replace rows of earlier ones with the same key
KEYS: dict[str, tuple[str, ...]] = {
    "control": ("event_id",),
    "members": ("system_uuid",),
    "sons": ("family_id", "version_seq", "system_uuid"),
}


def topic_bucket(topic: Column) -> Column:
    return F.pmod(F.hash(topic), F.lit(TOPIC_BUCKETS))


class StateTables:
    """Tables under one shared folder; keyed ones get a full copy every ``compact_every`` batches."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 50):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.compact_every = compact_every
        for name, schema in SCHEMAS.items():
            if name != "reports":
                self._write(spark.createDataFrame([], schema), name, -1)
        self.put_history(spark.createDataFrame([], SCHEMAS["reports"]), -1)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")

    def _floor(self, name: str, batch_id: int) -> int:
        """Earliest batch whose partition still matters to ``batch_id``."""
        full = (batch_id - 1) // self.compact_every * self.compact_every
        return full if name in KEYS and full > 0 else -1

    def log(self, name: str, batch_id: int) -> DataFrame:
        """All rows earlier batches left, with their ``batch``."""
        schema = T.StructType(SCHEMAS[name].fields + _fields(batch=_INT))
        rows = self.spark.read.schema(schema)
        if name in KEYS:
            # only the partitions that matter are looked at, however old the stream is
            batches = range(self._floor(name, batch_id), batch_id)
            folders = [f"{self.folder}/{name}/batch={i}" for i in batches]
            return rows.option("basePath", f"{self.folder}/{name}").parquet(*folders)
        return rows.parquet(f"{self.folder}/{name}").filter(F.col("batch") < batch_id)

    def put_history(self, reports: DataFrame, batch_id: int) -> None:
        """This batch's reports, one folder per topic bucket."""
        columns = [field.name for field in SCHEMAS["reports"].fields]
        rows = reports.select(*columns, topic_bucket(F.col("topic")).alias("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/reports/batch={batch_id}")

    def history(self, batch_id: int, topics: DataFrame) -> DataFrame:
        """Reports of earlier batches on the topics of a table's column ``topic``; other buckets are not read."""
        buckets = [row[0] for row in topics.select(topic_bucket(F.col("topic"))).distinct().collect()]
        schema = T.StructType(SCHEMAS["reports"].fields + _fields(batch=_INT, bucket=_INT))
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/reports")
        return rows.filter((F.col("batch") < batch_id) & F.col("bucket").isin(buckets)).drop("batch", "bucket")

    def prune(self, batch_id: int) -> None:
        """Remove partitions that a compaction made useless; no batch from ``batch_id`` on reads them."""
        for name in KEYS:
            floor, before = self._floor(name, batch_id), self._floor(name, batch_id - 1)
            if floor > before:
                delete(self.spark, *[f"{self.folder}/{name}/batch={i}" for i in range(before, floor)])

    def current(self, name: str, batch_id: int) -> DataFrame:
        """The rows that hold when ``batch_id`` starts: per key those of the last batch that wrote it."""
        log, keys = self.log(name, batch_id), list(KEYS[name])
        newest = log.groupBy(*keys).agg(F.max("batch").alias("batch"))
        return log.join(newest, [*keys, "batch"], "left_semi").drop("batch")

    def put(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Write this batch's rows; on a compaction batch also all others that still hold."""
        columns = [field.name for field in SCHEMAS[name].fields]
        rows = rows.select(*columns)
        if name in KEYS and batch_id > 0 and batch_id % self.compact_every == 0:
            kept = self.current(name, batch_id).join(rows.select(*KEYS[name]).distinct(), list(KEYS[name]), "left_anti")
            rows = rows.unionByName(kept.select(*columns))
        self._write(rows, name, batch_id)

    def put_output(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Write one partition of a result table."""
        self._write(rows, name, batch_id)

    def output(self, name: str, batch_id: int) -> DataFrame:
        """What one batch added to a result table."""
        return self.spark.read.parquet(f"{self.folder}/{name}/batch={batch_id}")

    def read(self, name: str) -> DataFrame:
        """A result table over all batches."""
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def arrival(self, batch_id: int) -> tuple[int, int]:
        """The greatest effective position any earlier batch held, and how far positions were moved on."""
        # a mark holds the greatest of all batches up to its own
        mark: Sequence | None = self.spark.read.schema(SCHEMAS["marks"]).parquet(f"{self.folder}/marks/batch={batch_id - 1}").first()
        return (-1, 0) if mark is None or mark[0] is None else (mark[0], mark[1])


__all__ = ["KEYS", "SCHEMAS", "StateTables", "topic_bucket"]

"""Append-only tables of changes: of rows with one key, that of the last step holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import scratch_path


class DeltaLog:
    """Changes by step, one folder each in the shared checkpoint folder; earlier ones are never written again."""

    def __init__(self, spark: SparkSession, schema: str, keys: tuple[str, ...]):
        self.spark, self.keys = spark, keys
        self.schema = spark.createDataFrame([], schema).schema
        self.path = scratch_path(spark)
        self.append(spark.createDataFrame([], schema), -1)

    def append(self, rows: DataFrame, step: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/step={step}")

    def rows(self) -> DataFrame:
        """All changes with their ``step``."""
        schema = T.StructType([*self.schema.fields, T.StructField("step", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def newest(self, wanted: DataFrame) -> DataFrame:
        """What holds for the keys of ``wanted``, with the step it is from."""
        return newest(self.rows().join(wanted.select(*self.keys).distinct(), list(self.keys), "left_semi"), self.keys)


def newest(changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of the changes of each key the last one."""
    values = ["step", *[c for c in changes.columns if c not in (*keys, "step")]]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "step").alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in values])

"""Generated sources: collections, inclusive ranges, uniform random integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The sample integers (there is no 7 among them), the sample words, the range ends
# of the fan-in sample, the upper limit of the random numbers.
SAMPLE_INTS = (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15)
SAMPLE_WORDS = "A B C"
SAMPLE_RANGES = ((100, 199), (200, 299))
RANDOM_LIMIT = 1_000_000


def collection(spark: SparkSession, items, kind: str) -> DataFrame:
    """Rows of an in-memory collection in order."""
    return spark.createDataFrame(list(enumerate(items)), f"pos int, value {kind}")


def inclusive_range(spark: SparkSession, low: int, high: int) -> DataFrame:
    """Integers from low to high, both included."""
    return spark.range(low, high + 1).withColumnRenamed("id", "value")


def random_ints(spark: SparkSession, rows: int, limit: int = RANDOM_LIMIT, seed: int = 0) -> DataFrame:
    """Uniform integers in [0, limit) as a finite batch."""
    return spark.range(rows).select(F.floor(F.rand(seed) * limit).cast("int").alias("value"))


def random_int_stream(spark: SparkSession, rows_per_second: int, limit: int = RANDOM_LIMIT) -> DataFrame:
    """The endless form of the same."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.pmod(F.xxhash64("value"), F.lit(limit)).cast("int").alias("value"))

"""Rate limits and named control of running queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

# The element intervals of the throttled samples, in milliseconds.
SAMPLE_INTERVALS_MS = (5, 10, 250, 500, 1000)


def throttled_rate(spark: SparkSession, interval_ms: int) -> DataFrame:
    """A generated stream of one element per interval.

    Intervals of a second or less that divide it become whole rows per second.
    """
    if interval_ms <= 0 or 1000 % interval_ms:
        raise ValueError("the interval has to divide one second")
    return spark.readStream.format("rate").option("rowsPerSecond", 1000 // interval_ms).load()


def throttled_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A parquet stream that admits a limited number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def every(interval_ms: int) -> dict[str, str]:
    """Trigger arguments for one micro-batch per interval."""
    return {"processingTime": f"{interval_ms} milliseconds"}


def running(spark: SparkSession, name: str) -> StreamingQuery | None:
    """The active query of that name."""
    return next((query for query in spark.streams.active if query.name == name), None)


def stop(spark: SparkSession, name: str) -> bool:
    """Stop one query from outside (D14); the others go on. False where none has that name."""
    query = running(spark, name)
    if query is None:
        return False
    query.stop()
    return True

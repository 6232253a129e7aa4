"""Latest attributes per source as a plain keyed stream (E7 where no merge or split occurs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.attributes import converted


def latest_per_source(reports: DataFrame) -> DataFrame:
    """(topic, external_id, last): the newest report of each source, a running aggregate.

    The maximum is combined before the exchange, so a source with most of the reports costs one row
    per task. For an update-mode sink; a merge or split needs the engine instead.
    """
    last = F.struct("pos", "offset", converted(F.col("report")).alias("attributes"))
    return reports.groupBy("topic", F.col("report.externalSystemID").alias("external_id")).agg(
        F.max_by(last, F.struct("pos", "offset")).alias("last")
    ).select("topic", "external_id", "last.pos", "last.offset", "last.attributes")


def latest_rows(changes: DataFrame) -> DataFrame:
    """The rows that hold, from a batch table of updates: per source those of its last batch."""
    newest = changes.groupBy("topic", "external_id").agg(F.max("batch").alias("batch"))
    return changes.join(newest, ["topic", "external_id", "batch"], "left_semi").drop("batch")

"""Reports to the family versions that listen to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .attributes import converted
from .intervals import FEW, interval_join

MODES = ("replay", "resume")

_SOURCE = ("sensor_id", "reports_id")
# what differs from version to version of a source
_OF_STEP = (
    "family_id", "version_seq", "state", "v_to", "n_sons", "son_ordinal", "same_source_ordinal", "same_source_uuid",
)
_VERSION = (*_OF_STEP, "v_from", "system_uuid", *_SOURCE, "data_offset")
ROUTED_COLUMNS = (
    "family_id", "version_seq", "state", "v_to", "n_sons", "pos", "topic", "offset", "sub_ordinal",
    "native", "reporter_ordinal", "reporter_uuid", "attributes",
)
# order of the records of one version; with the version it names one published record
RECORD_ORDER = ("pos", "topic", "offset", "sub_ordinal")


def read_from(reports: DataFrame, topic: str, reports_id: str | None = None, data_offset: int = 0) -> DataFrame:
    """One topic from an offset on, optionally only one external id."""
    kept = reports.filter((F.col("topic") == topic) & (F.col("offset") >= data_offset))
    return kept if reports_id is None else kept.filter(F.col("report.externalSystemID") == reports_id)


def read_from_offsets(reports: DataFrame, starts: DataFrame) -> DataFrame:
    """Several topics in one scan, each from its own offset: ``starts`` has topic, data_offset."""
    return reports.join(starts, "topic").filter(F.col("offset") >= F.col("data_offset"))


def read_sources(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """The reports of many source descriptors in one scan (S3, S4): one row per source and report."""
    return reports.join(
        sources,
        (F.col("topic") == F.col("sensor_id")) & (F.col("report.externalSystemID") == F.col("reports_id"))
        & (F.col("offset") >= F.col("data_offset")),
    )


def _native() -> Column:
    return F.col("report.basicAttributes.sourceName").eqNullSafe(F.col("topic"))


def _shaped(reports: DataFrame) -> DataFrame:
    """What routing needs of a report, taken before any join so that the scan reads only what is asked for."""
    named, external = F.col("report.basicAttributes.sourceName"), F.col("report.externalSystemID")
    return reports.select(
        "topic", "offset", "pos", F.col("topic").alias("sensor_id"), external.alias("reports_id"), _native().alias("native"),
        F.when(~_native(), named).alias("_named"), converted(F.col("report")).alias("attributes"),
    )


def subscribed(points: DataFrame, members: DataFrame, mode: str, few: int = FEW) -> DataFrame:
    """Each report, known by ``sensor_id`` and ``reports_id``, with every version subscribed to it.

    ``replay``: a version reads its sons from their first offset up to its own closing position.
    ``resume``: only what lies between its opening and its closing. ``members`` has the versions of a source
    without gaps, as they follow each other: all, or all from some version on.

    Either way a report meets versions by position bins. In ``resume`` a version is an interval of its own. In
    ``replay`` the versions of a source nest, so for sources with more than ``few`` of them a report
    looks for the one that is live then, and that one's later steps follow by number.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    versions = members.select(*_VERSION, "source_step")
    if mode == "resume":
        met = interval_join(points, versions, _SOURCE, "pos", "v_from", "v_to", few)
        return met.filter(F.col("offset") >= F.col("data_offset"))
    ends = versions.groupBy("system_uuid").agg(
        F.min("source_step").alias("_first"), F.max("source_step").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    many = F.col("_n") > few
    spans = versions.join(ends, "system_uuid").withColumn(
        "_since", F.when(many & (F.col("source_step") > F.col("_first")), F.col("v_from"))
    ).withColumn("_last", F.when(many, F.col("_last")).otherwise(F.col("source_step"))).drop("_first", "_n")
    met = interval_join(points, spans, _SOURCE, "pos", "_since", "v_to", few).filter(F.col("offset") >= F.col("data_offset"))
    steps = met.withColumn("_step", F.explode(F.sequence("source_step", "_last"))).withColumn(
        "_later", F.when(F.col("_step") > F.col("source_step"), F.col("_step"))
    )
    follow = materialize(versions.join(ends.filter(many).select("system_uuid"), "system_uuid").select(
        "system_uuid", F.col("source_step").alias("_later"), F.struct(*_OF_STEP).alias("_version")
    ))
    now = lambda c: F.when(F.col("_later").isNull(), F.col(c)).otherwise(F.col("_version")[c]).alias(c)
    return steps.join(follow, ["system_uuid", "_later"], "left").select(
        *points.columns, "system_uuid", *[now(c) for c in _OF_STEP]
    )


def route(reports: DataFrame, members: DataFrame, mode: str, few: int = FEW) -> DataFrame:
    """Subscribed reports with the son that reported (E2) and the converted attributes.

    A report whose record names its own topic as source is its subscriber's; the membership row
    says which son takes it. A report naming another source looks for that son among all sons
    of the version; the others have no key to look for. ``reporter_uuid`` is null where the family has no such son.
    """
    rows = subscribed(_shaped(reports), members, mode, few).withColumn("_id", F.when(~F.col("native"), F.col("reports_id")))
    sons = members.filter(F.col("son_ordinal") == F.col("same_source_ordinal")).select(
        "family_id", "version_seq", F.col("sensor_id").alias("_named"), F.col("reports_id").alias("_id"),
        F.col("son_ordinal").alias("_ordinal"), F.col("system_uuid").alias("_uuid"),
    )
    taken = lambda own, other: F.when(F.col("native"), F.col(own)).otherwise(F.col(other))
    return rows.join(sons, ["family_id", "version_seq", "_named", "_id"], "left").select(
        "family_id", "version_seq", "state", "v_to", "n_sons", "pos", "topic", "offset",
        F.col("son_ordinal").alias("sub_ordinal"), "native",
        taken("same_source_ordinal", "_ordinal").alias("reporter_ordinal"),
        taken("same_source_uuid", "_uuid").alias("reporter_uuid"), "attributes",
    )


def accepted(routed: DataFrame) -> DataFrame:
    """Reports of a son of the family they were routed to."""
    return routed.filter(F.col("reporter_uuid").isNotNull())


def rejected(routed: DataFrame) -> DataFrame:
    """Dead letters: the record names a source outside the family."""
    return routed.filter(~F.col("native") & F.col("reporter_uuid").isNull()).select(
        "family_id", "version_seq", "pos", "topic", "offset", "sub_ordinal",
        F.col("attributes.basicAttributes.sourceName").alias("source_name"),
        F.col("attributes.externalSystemID").alias("external_id"),
        F.lit("FOREIGN_SOURCE").alias("reason"),
    )

"""Control log and reports derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import uuid_of
from ..operators.control import control_union
from ..schemas import CREATION_TOPIC, MERGE_TOPIC, NATIONALITIES, SPLIT_TOPIC
from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def b1_sources(events: DataFrame) -> DataFrame:
    """One source per event type and user, known from its first event on."""
    return events.groupBy(
        F.col("event_type").alias("sensor_id"), F.col("user_id").cast("string").alias("reports_id"), "user_id"
    ).agg(F.min("event_id").alias("data_offset")).withColumn(
        "system_uuid", uuid_of(F.lit(CREATION_TOPIC), F.col("sensor_id"), F.col("reports_id"))
    )


def _share(events: DataFrame, times: int, parts: int):
    """floor(times * number of events / parts) as a scalar subquery."""
    return events.agg(F.floor(F.count(F.lit(1)) * times / parts).cast("bigint").alias("n")).scalar()


def b1_merge_lists(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Half-way, all sources of a user divisible by 3 become one family, in sensor order."""
    own = F.array_sort(F.collect_list(F.struct("sensor_id", "system_uuid")))
    return (
        sources.withColumn("pos", _share(events, 1, 2))
        .filter((F.col("user_id") % 3 == 0) & (F.col("data_offset") < F.col("pos")))
        .groupBy("user_id", "pos").agg(own["system_uuid"].alias("mergedEntitiesId"))
        .filter(F.size("mergedEntitiesId") >= 2)
        .withColumn("family_id", uuid_of(F.lit(MERGE_TOPIC), F.col("user_id").cast("string")))
    )


def b1_control(events: DataFrame, *more: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The B1 control log; ``more`` adds (merge, split) rows to the topics.

    The sources are written once: every topic is made from them, and the events are far more.
    """
    sources = materialize(b1_sources(events))
    creation = sources.select(
        F.col("data_offset").alias("pos"), F.col("data_offset").alias("offset"),
        F.concat_ws("|", "sensor_id", "reports_id").alias("event_key"),
        F.col("sensor_id").alias("sourceName"), F.col("reports_id").alias("externalSystemID"),
        F.col("data_offset").alias("dataOffset"),
    )
    lists = b1_merge_lists(events, sources)
    user_key = F.col("user_id").cast("string").alias("event_key")
    merge = lists.select("pos", F.col("user_id").alias("offset"), user_key, "mergedEntitiesId")
    split = lists.filter(F.col("user_id") % 6 == 0).select(
        _share(events, 3, 4).alias("pos"), F.col("user_id").alias("offset"), user_key,
        F.col("family_id").alias("splittedEntityID"),
    )
    for extra_merge, extra_split in more:
        merge, split = merge.unionByName(extra_merge), split.unionByName(extra_split)
    return control_union(creation, merge, split)


def b1_bad_topics(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that must all be refused, one per user at a quarter of the log."""
    users = b1_sources(events).groupBy("user_id").agg(
        F.min_by("system_uuid", F.struct("data_offset", "sensor_id")).alias("own")
    )
    unknown = uuid_of(F.lit("unknown"), F.col("user_id").cast("string"))
    case = F.col("user_id") % 7
    named = (
        F.when(case == 1, F.array(F.col("own"), unknown))
        .when(case == 3, F.array("own", "own"))
        .when(case == 4, F.array(F.col("own"), F.lit("not-a-uuid")))
        .when(case == 5, F.array().cast("array<string>"))
    )
    rows = users.select(
        _share(events, 1, 4).alias("pos"), F.col("user_id").alias("offset"),
        F.concat(F.lit("bad|"), F.col("user_id").cast("string")).alias("event_key"),
        case.alias("case"), named.alias("mergedEntitiesId"), unknown.alias("splittedEntityID"),
    )
    return (
        rows.filter(F.col("case").isin(1, 3, 4, 5)).select("pos", "offset", "event_key", "mergedEntitiesId"),
        rows.filter(F.col("case") == 2).select("pos", "offset", "event_key", "splittedEntityID"),
    )


def b1_reports(events: DataFrame, foreign: bool = False) -> DataFrame:
    """Events as reports; ``foreign`` (B2) delivers every 97th on the topic 'view'."""
    event_id, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    topic = F.when(event_id % 97 == 0, F.lit("view")).otherwise(kind) if foreign else kind
    nationality = (
        F.when(event_id % 3 == 0, NATIONALITIES[0]).when(event_id % 3 == 1, NATIONALITIES[1])
        .otherwise(NATIONALITIES[2])
    )
    basic = F.struct(
        F.struct(F.col("value").alias("lat"), user.cast("double").alias("long")).alias("coordinate"),
        (event_id % 2 == 0).alias("isNotTracked"), event_id.alias("entityOffset"), kind.alias("sourceName"),
    )
    report = F.struct(
        basic.alias("basicAttributes"), F.col("value").alias("speed"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("elevation"),
        (event_id % 360).cast("double").alias("course"), nationality.alias("nationality"),
        F.when(event_id % 2 == 0, "airplane").otherwise("boat").alias("category"),
        F.concat(F.lit("http://pics/"), event_id.cast("string")).alias("pictureURL"),
        (user % 10).cast("double").alias("height"),
        F.concat_ws("-", kind, user.cast("string")).alias("nickname"),
        user.cast("string").alias("externalSystemID"),
    )
    return events.select(topic.alias("topic"), event_id.alias("offset"), event_id.alias("pos"), report.alias("report"))


def b3_topics(events: DataFrame) -> DataFrame:
    """Raw rows of the topics of B1's creations and reports, as JSON, some of them spoiled.

    By ``event_id % 13``: 1 cut short, 2 no value, 3 without external id, 4 a category that is no symbol, 5 a text as
    speed. Of the creations, those of every seventh user are cut short.
    """
    case, report = F.col("offset") % 13, F.col("report")
    report = (
        F.when(case == 3, report.dropFields("externalSystemID").withField("externalSystemID", F.lit(None).cast("string")))
        .when(case == 4, report.withField("category", F.lit("tank"))).otherwise(report)
    )
    text = F.to_json(report)
    value = (
        F.when(case == 1, F.expr("substring(_text, 1, length(_text) - 1)")).when(case == 2, F.lit(None).cast("string"))
        .when(case == 5, F.regexp_replace("_text", '"speed":[^,]*,', '"speed":"fast",')).otherwise(F.col("_text"))
    )
    reports = b1_reports(events).withColumn("_text", text).select("topic", "offset", value.cast("binary").alias("value"))
    sources = b1_sources(events)
    creation = F.to_json(F.struct(
        F.col("sensor_id").alias("sourceName"), F.col("reports_id").alias("externalSystemID"), F.col("data_offset").alias("dataOffset")
    ))
    cut = F.when(F.col("user_id") % 7 == 0, F.expr("substring(_text, 1, length(_text) - 1)")).otherwise(F.col("_text"))
    created = sources.withColumn("_text", creation).select(
        F.lit(CREATION_TOPIC).alias("topic"), F.col("data_offset").alias("offset"), cut.cast("binary").alias("value")
    )
    return reports.unionByName(created)


def log_lines(events: DataFrame):
    """Events as log lines with a level tag, two tags or none."""
    tag = (
        F.when(F.col("event_type") == "error", "[ERROR]").when(F.col("event_type") == "purchase", "[INFO]")
        .when(F.col("event_type") == "signup", "[WARN]").when(F.col("event_type") == "click", "[DEBUG]")
        .otherwise("")
    )
    second = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 1), " [INFO]").otherwise("")
    return events.select(
        "event_id",
        F.concat(tag, F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "), F.col("props"), second).alias("line"),
    )

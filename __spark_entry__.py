
from __future__ import annotations

import importlib
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from kinweave.functions.text import log_level, tokens  # noqa: E402
from kinweave.operators import families, flows, registry, routing  # noqa: E402
from kinweave.operators.attributes import converted, flat_attributes, invalid_enum  # noqa: E402
from kinweave.operators.control import fan_in, validate  # noqa: E402
from kinweave.operators.lifecycle import Lifecycle, lifecycle  # noqa: E402
from kinweave.operators.ordered import ordered_concat, ordered_pieces, position_cuts, take_while_inclusive  # noqa: E402
from kinweave.plans.fusion import Fusion, fuse  # noqa: E402
from kinweave.schemas import ENTITY_FAMILY  # noqa: E402
from kinweave.session import checkpoint_dir, tune  # noqa: E402
from kinweave.sinks.files import batch_table, write_by_level, write_text  # noqa: E402
from kinweave.sinks.topics import update_messages  # noqa: E402
from kinweave.sources.bindings import (  # noqa: E402
    b1_bad_topics, b1_control, b1_reports, b3_topics, log_lines, table,
)
from kinweave.sources.files import lines_of_texts  # noqa: E402
from kinweave.sources.generators import inclusive_range  # noqa: E402
from kinweave.sources.topics import fusion_rows, rejected_records as undecodable  # noqa: E402
from kinweave.streaming.control import stop, throttled_files  # noqa: E402
from kinweave.streaming.engine import FusionStream, unified  # noqa: E402
from kinweave.streaming.keyed import switched_by_key, take_while_stream  # noqa: E402
from kinweave.streaming.latest import latest_per_source, latest_rows  # noqa: E402

MEMBER_COLUMNS = (
    "family_id", "version_seq", "state", "v_from", "v_to", "n_sons", "son_ordinal", "system_uuid",
    "sensor_id", "reports_id", "data_offset",
)
Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(tune(spark), sf_dir, "events")


def _lifecycle(spark: SparkSession, sf_dir: str) -> Lifecycle:
    return lifecycle(b1_control(_events(spark, sf_dir)))


def _bad_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return b1_control(events, b1_bad_topics(events))


def _fusion(spark: SparkSession, sf_dir: str, mode: str, foreign: bool = False, seeds: str | None = None) -> Fusion:
    events = _events(spark, sf_dir)
    return fuse(b1_control(events), b1_reports(events, foreign), mode, seeds)


def control_union(spark, sf_dir):
    control = b1_control(_events(spark, sf_dir))
    return control.withColumn("merged_ids", F.array_join("mergedEntitiesId", ",")).drop("mergedEntitiesId")


def control_validated(spark, sf_dir):
    return validate(_bad_control(spark, sf_dir)).select(
        "event_id", "kind", "pos", "event_key", F.size("ids").alias("n_ids"), "reason"
    )


def family_versions(spark, sf_dir):
    return _lifecycle(spark, sf_dir).members.select(*MEMBER_COLUMNS, "prev_family_id")


def membership_current(spark, sf_dir):
    return registry.current(_lifecycle(spark, sf_dir).sons()).select(*MEMBER_COLUMNS)


def membership_asof(spark, sf_dir):
    events = _events(spark, sf_dir)
    position = events.agg(F.floor(F.count(F.lit(1)) * 5 / 8).cast("bigint").alias("n")).scalar()
    return registry.as_of(_lifecycle(spark, sf_dir).sons(), position).select(*MEMBER_COLUMNS)


def rejected_events(spark, sf_dir):
    return lifecycle(_bad_control(spark, sf_dir)).rejected.select(
        "kind", "pos", "event_key", "reason", F.array_join("missing_ids", ",").alias("missing")
    )


def rejected_events_all(spark, sf_dir):
    """Besides the events of ``rejected_events``: every merge once more under its key, and kinds that do not exist."""
    events = _events(spark, sf_dir)
    control = b1_control(events)
    again = control.filter("kind = 'MERGE'").withColumn("pos", F.col("pos") + 1)
    quarter = events.agg(F.floor(F.count(F.lit(1)) / 4).cast("bigint").alias("n")).scalar()
    noise = events.filter("user_id % 7 = 6").select("user_id").distinct().select(
        quarter.alias("pos"), F.lit("DELETE").alias("kind"), F.lit("noise").alias("topic"), F.col("user_id").alias("offset"),
        F.concat(F.lit("noise|"), F.col("user_id").cast("string")).alias("event_key"),
    )
    return lifecycle(fan_in(b1_control(events, b1_bad_topics(events)), again, noise)).rejected.select(
        "kind", "pos", "event_key", "reason", F.array_join("missing_ids", ",").alias("missing")
    )


def source_registry(spark, sf_dir):
    return registry.created_sources(b1_control(_events(spark, sf_dir)))


def reports_from_offset(spark, sf_dir):
    reports = b1_reports(_events(spark, sf_dir))
    starts = reports.groupBy("topic").agg(
        F.floor((F.min("offset") + F.max("offset")) / 2).cast("bigint").alias("data_offset")
    )
    return routing.read_from_offsets(reports, starts).select(
        "topic", "offset", F.col("report.externalSystemID").alias("external_id"), F.col("report.speed").alias("speed")
    )


def reports_filtered(spark, sf_dir):
    events = _events(spark, sf_dir)
    sources = registry.created_sources(b1_control(events))
    return routing.read_sources(b1_reports(events), sources).select(
        "system_uuid", "topic", "offset", F.col("report.externalSystemID").alias("external_id"),
        F.col("report.speed").alias("speed"),
    )


def attributes_converted(spark, sf_dir):
    """Some reports have a nationality or category outside the symbols."""
    symbol = F.when(F.col("offset") % 11 == 0, "ATLANTIS").otherwise(F.col("report.nationality"))
    category = F.when(F.col("offset") % 13 != 0, F.col("report.category"))
    reports = b1_reports(_events(spark, sf_dir)).withColumn(
        "report", F.col("report").withField("nationality", symbol).withField("category", category)
    )
    return reports.select(
        "topic", "offset", invalid_enum(F.col("report")).alias("invalid_enum"),
        converted(F.col("report")).alias("attributes"),
    ).select("topic", "offset", *flat_attributes(F.col("attributes")), "invalid_enum")


def reports_routed(mode: str) -> Query:
    return lambda spark, sf_dir: _fusion(spark, sf_dir, mode).accepted.select(
        "family_id", "version_seq", "state", "n_sons", "pos", "topic", "offset", "sub_ordinal", "reporter_uuid"
    )


def reports_routed_foreign(mode: str) -> Query:
    return lambda spark, sf_dir: _fusion(spark, sf_dir, mode, foreign=True).accepted.select(
        "family_id", "version_seq", "state", "n_sons", "pos", "topic", "offset", "sub_ordinal",
        "reporter_ordinal", "reporter_uuid",
        F.col("attributes.basicAttributes.sourceName").alias("source_name"),
    )


def rejected_reports(spark, sf_dir):
    return _fusion(spark, sf_dir, "replay", foreign=True).rejected_reports.drop("sub_ordinal")


def rejected_records(spark, sf_dir):
    """Dead letters of decoding."""
    rows = b3_topics(_events(spark, sf_dir))
    return undecodable(rows, F.col("offset")).select(
        "topic", "offset", "pos", "reason", F.array_join("fields", ",").alias("fields")
    )


def decoded_records(spark, sf_dir):
    """What decodes of the same topics, as one log."""
    return fusion_rows(b3_topics(_events(spark, sf_dir)), F.col("offset")).select(
        "kind", "topic", "offset", "pos", "sourceName", "dataOffset", F.col("report.speed").alias("speed"),
        F.coalesce("externalSystemID", "report.externalSystemID").alias("external_id"),
    )


def son_latest(spark, sf_dir):
    return families.son_latest(_fusion(spark, sf_dir, "replay").routed).select(
        "family_id", "version_seq", "system_uuid", "pos", *flat_attributes(F.col("attributes"))
    )


def preferred_son(spark, sf_dir):
    return families.preferred_son(_fusion(spark, sf_dir, "replay").routed).select(
        "family_id", "version_seq", "system_uuid", "pos", *flat_attributes(F.col("attributes"))
    )


def family_seeds(mode: str) -> Query:
    return lambda spark, sf_dir: _fusion(spark, sf_dir, mode).seeds.select(
        "family_id", "version_seq", "system_uuid", *flat_attributes(F.col("seed"))
    )


def exploded_records(records: DataFrame) -> DataFrame:
    """Family records with one row per son, scalar columns only."""
    return records.select(
        "entityID", "version_seq", "pos", "topic", "offset", "stateChanges",
        F.col("entityAttributes.nickname").alias("preferred_nickname"),
        F.col("entityAttributes.speed").alias("preferred_speed"),
        F.posexplode("sons").alias("son_ordinal", "_son"),
    ).select(
        "entityID", "version_seq", "pos", "topic", "offset", "stateChanges", "preferred_nickname",
        "preferred_speed", "son_ordinal", F.col("_son.entityID").alias("son_id"),
        *flat_attributes(F.col("_son.entityAttributes"), "son_"),
    )


def family_updates(mode: str) -> Query:
    return lambda spark, sf_dir: exploded_records(_fusion(spark, sf_dir, mode).records)


def family_complete(spark, sf_dir):
    known = F.filter("sons", lambda s: s["entityAttributes"].isNotNull())
    return _fusion(spark, sf_dir, "replay").records.select(
        "entityID", "version_seq", "pos", "topic", "offset", F.size("sons").alias("n_sons"),
        F.size(known).alias("n_known"), "complete",
    )


def state_changes(spark, sf_dir):
    return _fusion(spark, sf_dir, "replay").records.filter("stateChanges <> 'NONE'").select(
        "entityID", "version_seq", "pos", "topic", "offset", "stateChanges"
    )


def family_sons(spark, sf_dir):
    return registry.explode_sons(_fusion(spark, sf_dir, "resume").records).select(
        "entityID", "version_seq", "pos", F.col("son_ordinal_in_family").alias("son_ordinal"),
        "son_id", "son_source", "son_external_id",
    )


def published_updates(spark, sf_dir):
    messages = update_messages(_fusion(spark, sf_dir, "resume").records)
    record = F.from_json("value", ENTITY_FAMILY)
    offsets = F.aggregate(
        F.transform("r.sons", lambda s: s["entityAttributes"]["basicAttributes"]["entityOffset"]),
        F.lit(None).cast("bigint"),
        lambda a, x: F.when(a.isNull(), x).when(x.isNull(), a).otherwise(a + x),
    )
    return messages.select("topic", "key", record.alias("r")).select(
        "topic", "key", F.col("r.stateChanges").alias("stateChanges"),
        F.col("r.entityAttributes.basicAttributes.entityOffset").alias("entity_offset"),
        F.col("r.entityAttributes.nickname").alias("nickname"), F.size("r.sons").alias("n_sons"),
        offsets.alias("sum_son_offsets"),
    )


def family_snapshot(spark, sf_dir):
    return _fusion(spark, sf_dir, "replay").snapshot.select(
        "entityID", "version_seq", "pos", "n_sons", "live", "preferred_uuid",
        F.col("entityAttributes.nickname").alias("preferred_nickname"), "son_ordinal", "son_id",
        *flat_attributes(F.col("son_attributes"), "son_"),
    )


def merged_ranges(spark, sf_dir):
    def span(name, key):
        low, high = table(tune(spark), sf_dir, name).agg(F.min(key), F.max(key)).first()
        return inclusive_range(spark, low, high).withColumn("branch", F.lit(name))

    return fan_in(span("orders", "o_orderkey"), span("events", "event_id"))


def mapped_branches(spark, sf_dir):
    keys = table(tune(spark), sf_dir, "orders").select(F.col("o_orderkey").alias("value"))
    step = lambda df: df.withColumn("value", F.col("value") + 1)
    return flows.branches(keys, first=step, second=step)


def tee_suffix(spark, sf_dir):
    texts = table(tune(spark), sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    return flows.branches(
        texts, tee=lambda df: df, main=lambda df: df.withColumn("value", F.concat("value", F.lit("- supervisor")))
    )


def upper_case(spark, sf_dir):
    return table(tune(spark), sf_dir, "documents").select("doc_id", F.upper("text").alias("value"))


def twin_primes(spark, sf_dir):
    return flows.twin_primes(table(tune(spark), sf_dir, "orders"), "o_orderkey")


def variant_collect(spark, sf_dir):
    return flows.collect_variant(
        _events(spark, sf_dir), F.col("event_type"), "purchase", F.col("value"), "event_id"
    )


def take_while(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type")
    return take_while_inclusive(events, ["user_id"], ["event_id"], F.col("event_type") != "error")


def ordered_fold(spark, sf_dir):
    letters = _events(spark, sf_dir).select("user_id", "event_id", F.substring("event_type", 1, 1).alias("letter"))
    cuts = position_cuts(letters, "event_id", 4_000_000)
    return ordered_concat(letters, ["user_id"], ["event_id"], "letter", "folded", cuts)


def ordered_fold_pieces(spark, sf_dir):
    """The same fold as placed pieces of 64 events: no cell grows with its user."""
    letters = _events(spark, sf_dir).select("user_id", "event_id", F.substring("event_type", 1, 1).alias("letter"))
    cuts = position_cuts(letters, "event_id", 4_000_000)
    return ordered_pieces(letters, ["user_id"], ["event_id"], "letter", cuts, separator="-", rows_per_piece=64)


def tokenize(spark, sf_dir):
    return table(tune(spark), sf_dir, "documents").select(
        "doc_id", F.posexplode(tokens(F.col("text"))).alias("token_no", "token")
    )


def log_levels(spark, sf_dir):
    return log_lines(_events(spark, sf_dir)).withColumn("level", log_level(F.col("line")))


def text_written(spark, sf_dir):
    """Log lines written as text and read back, with the number of bytes the sink reports."""
    path = f"{_scratch(spark, 'text')}/out"
    size = write_text(log_lines(_events(spark, sf_dir)), "line", path)
    return spark.read.text(path).select(F.col("value").alias("line"), F.lit(size).cast("bigint").alias("n_bytes"))


def lines_by_level(spark, sf_dir):
    """Log lines written to one folder per level and read back from there."""
    path = f"{_scratch(spark, 'levels')}/out"
    write_by_level(log_lines(_events(spark, sf_dir)), path)
    return spark.read.schema("value string, level string").text(path).select(F.col("value").alias("line"), "level")


def observed_events(spark, sf_dir):
    """Errors that pass through, with what was observed of all events on their way."""
    path = f"{_scratch(spark, 'observed')}/out"
    passed, seen = flows.counted(
        _events(spark, sf_dir), f"events-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"), F.max("event_id").alias("top")
    )
    passed.filter("event_type = 'error'").write.parquet(path)
    found = seen.get
    return spark.read.parquet(path).select(
        "event_id", F.lit(found["n"]).cast("bigint").alias("n_events"), F.lit(found["top"]).cast("bigint").alias("last_event")
    )


def file_lines(spark, sf_dir):
    return lines_of_texts(table(tune(spark), sf_dir, "documents"), "doc_id")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_updates(spark, sf_dir):
    """The same records from a stream that arrives in two parts and is restarted between them."""
    return _streamed_in_two_parts(spark, sf_dir, F.lit(False))


def stream_late_updates(spark, sf_dir):
    """As above, but a tenth of the reports of the first part come with the second: they take effect then."""
    return _streamed_in_two_parts(spark, sf_dir, (F.col("kind") == "REPORT") & (F.col("offset") % 10 == 7))


def _streamed_in_two_parts(spark, sf_dir, late):
    events = _events(spark, sf_dir)
    folder = _scratch(spark, "stream-updates")
    cut = events.agg(F.floor(F.count(F.lit(1)) * 5 / 8).cast("bigint").alias("n")).scalar()
    rows = unified(b1_control(events), b1_reports(events)).withColumn("part", late | (F.col("pos") >= cut))
    engine = FusionStream(spark, f"{folder}/state", "resume")
    for part in (False, True):
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(rows.drop("part").schema).parquet(f"{folder}/in")
        engine.start(arrived, f"fusion-{uuid.uuid4().hex}", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    # as the reports gave them; what comes late takes effect at a position further on
    return exploded_records(engine.state.read("updates").withColumn("pos", F.col("event_pos")))


def _event_stream(spark, sf_dir, folder, files=4, per_batch=None):
    """All events as a stream over several files."""
    events = _events(spark, sf_dir)
    events.repartition(files).write.parquet(f"{folder}/in")
    reader = spark.readStream.schema(events.schema)
    if per_batch:
        return throttled_files(spark, f"{folder}/in", events.schema, per_batch)
    return reader.parquet(f"{folder}/in")


def stream_latest(spark, sf_dir):
    folder = _scratch(spark, "stream-latest")
    reports = b1_reports(_event_stream(spark, sf_dir, folder, per_batch=2))
    batch_table(
        latest_per_source(reports), f"{folder}/out", f"{folder}/checkpoint", output_mode="update", availableNow=True
    ).awaitTermination()
    return latest_rows(spark.read.parquet(f"{folder}/out")).select(
        "topic", "external_id", "pos", F.col("attributes.nickname").alias("nickname"),
        F.col("attributes.speed").alias("speed"),
    )


def throttled_stream(spark, sf_dir):
    """Every event of four files, and the number of micro-batches that one file each makes of them."""
    folder = _scratch(spark, "throttled")
    events = _event_stream(spark, sf_dir, folder, per_batch=1)
    batch_table(events, f"{folder}/out", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    arrived = spark.read.parquet(f"{folder}/out")
    batches = arrived.agg(F.countDistinct("batch").alias("n")).scalar()
    return arrived.select("event_id", "event_type", batches.alias("n_batches"))


def _keyed_in_parts(spark, sf_dir, name, step):
    """All events through one keyed stream that is stopped and started again between three parts."""
    folder = _scratch(spark, name)
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type")
    for low, high in _thirds(events):
        events.filter((F.col("event_id") > low) & (F.col("event_id") <= high)).write.mode("append").parquet(f"{folder}/in")
        arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        batch_table(step(arrived), f"{folder}/out", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _thirds(events):
    """Ranges of ids that together hold all events."""
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [low - 1, low + (high - low) // 3, low + 2 * (high - low) // 3, high]
    return zip(cuts, cuts[1:])


def stream_take_while(spark, sf_dir):
    """As take_while, but what has ended is state that a restarted query finds again."""
    return _keyed_in_parts(
        spark, sf_dir, "stream-take-while",
        lambda rows: take_while_stream(rows, ["user_id"], ["event_id"], F.col("event_type") != "error"),
    )


def stream_killed_by_key(spark, sf_dir):
    """One query for all users: an error kills its user, a signup starts it again."""
    action = F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "signup", True)
    return _keyed_in_parts(
        spark, sf_dir, "stream-killed", lambda rows: switched_by_key(rows, ["user_id"], ["event_id"], action)
    )


def stop_by_name(spark, sf_dir):
    """Three named pipelines over all events; B is stopped, the others finish undisturbed.

    The last row tells whether B was found, ended, and can no longer be found.
    """
    folder = _scratch(spark, "stop-by-name")
    events = _event_stream(spark, sf_dir, folder)
    prefix = uuid.uuid4().hex
    started = {
        key: batch_table(events, f"{folder}/{key}", f"{folder}/checkpoint-{key}", name=f"{prefix}-{key}")
        for key in ("A", "B", "C")
    }
    stopped = stop(spark, f"{prefix}-B") and not started["B"].isActive and not stop(spark, f"{prefix}-B")
    for key in ("A", "C"):
        started[key].processAllAvailable()
        stop(spark, f"{prefix}-{key}")
    finished = [
        spark.read.parquet(f"{folder}/{key}").select(F.lit(key).alias("pipeline"), "event_id", F.lit(False).alias("stopped"))
        for key in ("A", "C")
    ]
    last = _events(spark, sf_dir).agg(F.max("event_id").alias("event_id"))
    return fan_in(*finished, last.select(F.lit("B").alias("pipeline"), "event_id", F.lit(stopped).alias("stopped")))


def entry(spark: SparkSession) -> DataFrame:
    """Every report of a data set (ENTRY_SF_DIR, else the smallest) as a family record, one row per son."""
    return family_updates("replay")(spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001"))


def _optional(name: str):
    """A module that may be absent as a whole; an import that fails inside it is an error."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as error:
        if error.name not in ("kinweave.llm", "kinweave.llm.queries", "corpus_pipeline"):
            raise
        return None


_llm, _pipeline = _optional("kinweave.llm.queries"), _optional("corpus_pipeline")


def queries() -> dict[str, Query]:
    found = _own_queries()
    if _llm:
        found |= _llm.queries()
    if _pipeline:
        found["pipeline"] = _pipeline.run
    return found


def _own_queries() -> dict[str, Query]:
    return {
        "control_union": control_union,
        "control_validated": control_validated,
        "family_versions": family_versions,
        "membership_current": membership_current,
        "membership_asof": membership_asof,
        "rejected_events": rejected_events,
        "rejected_events_all": rejected_events_all,
        "source_registry": source_registry,
        "reports_from_offset": reports_from_offset,
        "reports_filtered": reports_filtered,
        "attributes_converted": attributes_converted,
        "reports_routed_resume": reports_routed("resume"),
        "reports_routed_replay": reports_routed("replay"),
        "reports_routed_foreign_resume": reports_routed_foreign("resume"),
        "reports_routed_foreign_replay": reports_routed_foreign("replay"),
        "rejected_reports": rejected_reports,
        "rejected_records": rejected_records,
        "decoded_records": decoded_records,
        "son_latest": son_latest,
        "preferred_son": preferred_son,
        "family_seeds": family_seeds("replay"),
        "family_seeds_carry": family_seeds("resume"),
        "family_updates_resume": family_updates("resume"),
        "family_updates_replay": family_updates("replay"),
        "family_complete": family_complete,
        "state_changes": state_changes,
        "family_sons": family_sons,
        "published_updates": published_updates,
        "family_snapshot": family_snapshot,
        "stream_updates": stream_updates,
        "stream_late_updates": stream_late_updates,
        "stream_latest": stream_latest,
        "throttled_stream": throttled_stream,
        "stop_by_name": stop_by_name,
        "stream_take_while": stream_take_while,
        "stream_killed_by_key": stream_killed_by_key,
        "merged_ranges": merged_ranges,
        "mapped_branches": mapped_branches,
        "tee_suffix": tee_suffix,
        "upper_case": upper_case,
        "twin_primes": twin_primes,
        "variant_collect": variant_collect,
        "take_while": take_while,
        "ordered_fold": ordered_fold,
        "ordered_fold_pieces": ordered_fold_pieces,
        "tokenize": tokenize,
        "log_levels": log_levels,
        "file_lines": file_lines,
        "text_written": text_written,
        "lines_by_level": lines_by_level,
        "observed_events": observed_events,
    }


def oracle_sql() -> dict[str, str]:
    sql = oracles.oracle_sql()
    found = {name: sql[name] for name in _own_queries() if name in sql}
    if _llm:
        found |= _llm.oracle_sql()
    if _pipeline and _pipeline.ORACLE_SQL:
        found["pipeline"] = _pipeline.ORACLE_SQL
    return found

"""The report fold: family records from routed reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import CHUNK, latest, position_cuts, previous_known, with_chunk
from .routing import RECORD_ORDER, accepted

SEEDS = ("own", "carry", "none")
RECORD_SONS_PER_CHUNK = 4_000_000
RECORDS_PER_BLOCK = 16
RECORD_SONS_PER_TASK = 250_000

VERSION = ("family_id", "version_seq")
_ORDER = list(RECORD_ORDER)


def son_latest(routed: DataFrame) -> DataFrame:
    """Latest accepted attributes of every son that reported, per version."""
    return accepted(routed).groupBy(*VERSION, F.col("reporter_uuid").alias("system_uuid")).agg(
        latest(_ORDER, F.struct(*_ORDER, "attributes")).alias("_last")
    ).select(*VERSION, "system_uuid", *[F.col("_last")[name].alias(name) for name in [*_ORDER, "attributes"]])


def preferred_son(routed: DataFrame) -> DataFrame:
    """The son each version prefers in the end, that is the last reporter."""
    return accepted(routed).groupBy(*VERSION).agg(
        latest(_ORDER, F.struct(*_ORDER, "reporter_uuid", "attributes")).alias("_last")
    ).select(*VERSION, F.col("_last.reporter_uuid").alias("system_uuid"),
             *[F.col("_last")[name].alias(name) for name in [*_ORDER, "attributes"]])


def seeds(
    routed: DataFrame,
    members: DataFrame,
    how: str,
    rows_per_chunk: int = RECORD_SONS_PER_CHUNK,
    known: DataFrame | None = None,
) -> DataFrame:
    """(family_id, version_seq, system_uuid, seed): what a son starts a version with.

    ``own``: the last report of the version right before, if that version bore the son's own id.
    ``carry``: the son's last attributes from any earlier version. ``none``: no rows. ``known``
    holds rows of ``son_latest`` from earlier runs; where both have a row, ``routed`` is newer.
    """
    columns = [*VERSION, "system_uuid", "seed"]
    if how not in SEEDS:
        raise ValueError(f"seeds is one of {SEEDS}")
    if how == "none":
        return members.filter(F.lit(False)).select(
            *VERSION, "system_uuid", F.lit(None).cast(routed.schema["attributes"].dataType).alias("seed")
        )
    ended = routed.filter(F.col("v_to").isNotNull())
    if how == "own":
        # such a version always has one son, so its last report is that son's
        ended = ended.filter((F.col("n_sons") == 1) & (F.col("family_id") == F.col("reporter_uuid")))
    last = son_latest(ended).select(*VERSION, "system_uuid", F.col("attributes").alias("_last"))
    if known is not None:
        earlier = known.join(last, [*VERSION, "system_uuid"], "left_anti")
        last = last.unionByName(earlier.select(*VERSION, "system_uuid", F.col("attributes").alias("_last")))
    if how == "own":
        heirs = members.filter(F.col("prev_family_id") == F.col("system_uuid"))
        last = last.select(
            F.col("family_id").alias("prev_family_id"), F.col("version_seq").alias("prev_version_seq"),
            "system_uuid", F.col("_last").alias("seed"),
        )
        return heirs.join(last, ["prev_family_id", "prev_version_seq", "system_uuid"]).select(*columns)
    steps = members.filter(F.col("v_to").isNotNull() | F.col("prev_family_id").isNotNull()).select(
        *VERSION, "system_uuid", "source_step"
    )
    cuts = position_cuts(steps, "source_step", rows_per_chunk)
    history = steps.join(last, [*VERSION, "system_uuid"], "left")
    carried = previous_known(history, ["system_uuid"], ["source_step"], "_last", "seed", cuts)
    return carried.filter(F.col("seed").isNotNull()).select(*columns)


def _of_one_source(rows: DataFrame) -> DataFrame:
    """Records of versions that are just one created source: the reporter is the family."""
    son = F.struct(F.col("reporter_uuid").alias("entityID"), F.col("attributes").alias("entityAttributes"))
    return rows.select(
        *VERSION, *_ORDER, "reporter_uuid", F.lit("NONE").alias("stateChanges"),
        F.col("attributes").alias("entityAttributes"), F.array(son).alias("sons"),
        F.lit(True).alias("complete"),
    )


def family_records(
    routed: DataFrame,
    members: DataFrame,
    seed_rows: DataFrame,
    started: DataFrame | None = None,
    record_sons_per_chunk: int = RECORD_SONS_PER_CHUNK,
) -> DataFrame:
    """One family record per accepted report.

    ``entityAttributes`` are the reporter's; ``sons`` lists every son in ordinal order with what is
    known of it then, null before its first report or seed; the first record of a version carries
    the version's state, later ones NONE. ``started``: versions that already published a record.

    Versions of one created source need no grouping at all. The others are grouped by (version,
    position chunk): one exchange of the reports, then the sons' histories are filled inside the
    chunk from the state at its start. A busy family is thus spread over as many tasks as its
    records times sons ask for.
    """
    told = accepted(routed)
    plain = told.filter((F.col("n_sons") == 1) & (F.col("state") == "NONE") & F.col("native"))
    grouped = told.filter(~((F.col("n_sons") == 1) & (F.col("state") == "NONE")))

    work, cuts = _chunk_cuts(grouped, record_sons_per_chunk)
    # never below the session's number, or Spark would exchange the reports once more for the join
    least = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(math.ceil(work / RECORD_SONS_PER_TASK), least, 2)
    start = members.filter("state <> 'NONE'").select(*VERSION, "son_ordinal", "system_uuid").join(
        seed_rows, [*VERSION, "system_uuid"], "left"
    )
    keyed = [*VERSION]
    opens = F.lit(True)
    if cuts:
        keyed = [*VERSION, CHUNK]
        grouped = with_chunk(grouped, "pos", cuts)
        start = _state_at_chunks(grouped, start)
        opens = F.col("_first_chunk")
    if started is not None:
        start = start.join(
            started.select(*VERSION).distinct().withColumn("_started", F.lit(True)), [*VERSION], "left"
        )
        opens = opens & F.col("_started").isNull()

    return _of_one_source(plain).unionByName(
        _of_several(grouped, start, keyed, opens, tasks)
    ).withColumnRenamed("family_id", "entityID")


def _of_several(grouped: DataFrame, start: DataFrame, keyed: list[str], opens: Column, tasks: int) -> DataFrame:
    """Records of all other versions, after one exchange of the reports by ``keyed``.

    The rows grow by the number of sons after that exchange, so its tasks are sized by what they
    will put out, not by what they take in. The reports of a group are put in order and cut into short blocks. What each son knows is
    carried from block to block by a window over (block, son) rows, and inside a block it is looked
    up in the block's few reports. So the rows to sort are the reports and a small multiple of
    sons, not one row per record and son.
    """
    in_order = Window.partitionBy(*keyed).orderBy(*_ORDER)
    entry = F.struct(*_ORDER, "_n", "reporter_ordinal", "reporter_uuid", "attributes")
    blocks = (
        grouped.select(*keyed, *_ORDER, "reporter_ordinal", "reporter_uuid", "state", "attributes")
        .repartition(tasks, *keyed).withColumn("_n", F.row_number().over(in_order))
        .withColumn("_block", F.floor((F.col("_n") - 1) / RECORDS_PER_BLOCK))
        .groupBy(*keyed, "_block")
        .agg(F.sort_array(F.collect_list(entry)).alias("_entries"), F.first("state").alias("state"))
    )
    own = F.filter("_entries", lambda e: e["reporter_ordinal"] == F.col("son_ordinal"))
    # a broadcast of the reports, where they are few, would undo their partitioning
    per_son = blocks.join(start.withColumn("_opens", opens).hint("merge"), keyed).select(
        *keyed, "_block", "son_ordinal", "system_uuid", "seed", "state", "_opens",
        F.get(own, F.size(own) - 1)["attributes"].alias("_end"),
        F.when(F.col("son_ordinal") == 0, F.col("_entries")).alias("_entries"),
    )
    earlier = Window.partitionBy(*keyed, "son_ordinal").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_son = per_son.withColumn("_known", F.coalesce(F.last("_end", ignorenulls=True).over(earlier), "seed"))
    whole = per_son.groupBy(*keyed, "_block").agg(
        F.sort_array(F.collect_list(F.struct("son_ordinal", "system_uuid", "_known"))).alias("_sons"),
        F.first("_entries", ignorenulls=True).alias("_entries"),
        F.first("state").alias("state"), F.first("_opens").alias("_opens"),
    ).withColumn("_reporters", F.col("_entries.reporter_ordinal"))

    def record(e: Column, place: Column) -> Column:
        def son(s: Column) -> Column:
            heard = F.transform("_reporters", lambda r, k: F.when((r == s["son_ordinal"]) & (k <= place), k))
            told = F.get("_entries", F.array_max(heard))["attributes"]
            return F.struct(
                s["system_uuid"].alias("entityID"), F.coalesce(told, s["_known"]).alias("entityAttributes")
            )

        return F.struct(
            *[e[name].alias(name) for name in [*_ORDER, "reporter_uuid"]],
            F.when(F.col("_opens") & (e["_n"] == 1), F.col("state")).otherwise("NONE").alias("stateChanges"),
            e["attributes"].alias("entityAttributes"),
            F.transform("_sons", son).alias("sons"),
        )

    return whole.select(*VERSION, F.inline(F.transform("_entries", record))).withColumn(
        "complete", F.forall("sons", lambda s: s["entityAttributes"].isNotNull())
    )


def _state_at_chunks(grouped: DataFrame, start: DataFrame) -> DataFrame:
    """Per version, chunk and son: what is known when the chunk begins."""
    keyed = [*VERSION, CHUNK]
    ends = grouped.groupBy(*keyed, F.col("reporter_ordinal").alias("son_ordinal")).agg(
        latest(_ORDER, F.col("attributes")).alias("_end")
    )
    by_chunk = Window.partitionBy(*VERSION).orderBy(CHUNK)
    busy = ends.select(*keyed).distinct().withColumn("_first_chunk", F.row_number().over(by_chunk) == 1)
    before = Window.partitionBy(*VERSION, "son_ordinal").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        busy.join(start, [*VERSION])
        .join(ends, [*keyed, "son_ordinal"], "left")
        .withColumn("seed", F.coalesce(F.last("_end", ignorenulls=True).over(before), "seed"))
        .drop("_end")
    )


def _chunk_cuts(grouped: DataFrame, limit: int) -> tuple[int, list[float]]:
    """The work (records times sons) and the borders that cut it into equal chunks, if any."""
    work = grouped.agg(F.sum("n_sons")).first()[0] or 0
    if work <= limit:
        return work, []
    weighted = grouped.select("pos", F.explode(F.sequence(F.lit(1), "n_sons")).alias("_i"))
    return work, position_cuts(weighted, "pos", limit, work)


def family_snapshot(routed: DataFrame, members: DataFrame, seed_rows: DataFrame) -> DataFrame:
    """The last record of every family id, one row per son.

    An id may live through several versions; the last one that published counts. It is built from
    the sons' latest attributes, so the record log itself is not needed.
    """
    last = son_latest(routed)
    newest = last.groupBy("family_id").agg(F.max(F.struct("version_seq", *_ORDER, "system_uuid", "attributes")).alias("_n"))
    newest = newest.select(
        "family_id", F.col("_n.version_seq").alias("version_seq"), *[F.col("_n")[name].alias(name) for name in _ORDER],
        F.col("_n.system_uuid").alias("preferred_uuid"), F.col("_n.attributes").alias("entityAttributes"),
    )
    live = members.filter(F.col("v_to").isNull()).select("family_id").distinct().withColumn("_live", F.lit(True))
    sons = members.select(*VERSION, "system_uuid", "son_ordinal", "n_sons")
    return (
        newest.join(sons, [*VERSION])
        .join(last.select(*VERSION, "system_uuid", F.col("attributes").alias("_told")), [*VERSION, "system_uuid"], "left")
        .join(seed_rows, [*VERSION, "system_uuid"], "left")
        .join(live, "family_id", "left")
        .select(
            F.col("family_id").alias("entityID"), "version_seq", *_ORDER, "n_sons",
            F.coalesce("_live", F.lit(False)).alias("live"), "preferred_uuid", "entityAttributes",
            "son_ordinal", F.col("system_uuid").alias("son_id"),
            F.coalesce("_told", "seed").alias("son_attributes"),
        )
    )

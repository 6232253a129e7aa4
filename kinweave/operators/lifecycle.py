"""CREATE, MERGE and SPLIT of families as Spark jobs (F1-F9): versions with their sons."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MEMBERSHIP_COLUMNS
from ..session import materialize
from .components import component_labels
from .control import ORDER, fan_in, validate
from .delta import DeltaLog, newest
from .genealogy import FOLD_INPUT, FOLD_OUTPUT, fold
from .intervals import interval_join
from .ordered import ordinal, position_cuts, previous_known, with_chunk

BLOCK_EVENTS = 1_000_000
VERSION_ROWS_PER_CHUNK = 2_000_000


#: Columns of a version besides its sons.
_VERSION = ("family_id", "opened_by", "version_seq", *ORDER, "state", "v_to", "n_sons")


@dataclass
class Lifecycle:
    """Stored in rows that grow with events and sources, however deep merges nest.

    ``versions``: one row per family version. A version of one source names it in ``only``; the sons of a merged one are
    the leaves ``low`` to ``high`` of its merge ``tree``, in order. ``leaves``: which source stands at
    which place of a tree. ``rejected``: refused control events. ``components``: (node, component) of every id that a
    held merge links to others.
    """

    versions: DataFrame
    leaves: DataFrame
    sources: DataFrame
    cuts: list[float]
    rejected: DataFrame
    components: DataFrame

    def sons(self) -> DataFrame:
        """One row per family version and son, expanded when read: a filter on versions comes first."""
        version = self.versions.select(*_VERSION, "only", "tree", "low", "high")
        place = lambda n: n.cast("int").alias("son_ordinal")
        one = version.filter("only is not null").select(*_VERSION, place(F.lit(0)), F.col("only").alias("system_uuid"))
        several = interval_join(
            self.leaves, version.filter("only is null").drop("only"), ["tree"], "ordinal", "low", "high"
        ).select(*_VERSION, place(F.col("ordinal") - F.col("low")), "system_uuid")
        return one.unionByName(several).join(self.sources, "system_uuid").withColumn("v_from", F.col("pos")).withColumn(
            "n_sons", F.col("n_sons").cast("int")
        )

    @cached_property
    def members(self) -> DataFrame:
        """The sons with their history (MEMBERSHIP_COLUMNS); written when first asked for, as its readers are many."""
        return materialize(_with_history(self.sons(), self.cuts))


def _node(family: str, opened_by: str) -> Column:
    return F.concat_ws("/", family, opened_by)


def _mark_repeated(control: DataFrame) -> DataFrame:
    """An event key seen before is the same event again: refused."""
    first = control.groupBy("event_id").agg(
        F.min(F.struct(*ORDER)).alias("_first"), F.count(F.lit(1)).alias("_n")
    ).filter("_n > 1").select("event_id", "_first")
    return (
        control.join(first, "event_id", "left")
        .withColumn("reason", F.when(F.struct(*ORDER) > F.col("_first"), "DUPLICATE_EVENT").otherwise(F.col("reason")))
        .drop("_first")
    )


def _fold_rows(rows: DataFrame, hand_over: bool = False) -> DataFrame:
    ordered = rows.repartition("component").sortWithinPartitions("component", "stage", *ORDER)
    return ordered.mapInPandas(fold(hand_over), FOLD_OUTPUT)


def _as_fold_input(rows: DataFrame, **extra: Column) -> DataFrame:
    names = [part.split() for part in FOLD_INPUT.split(", ")]
    present = set(rows.columns)
    return rows.select(*[
        extra[name].cast(kind).alias(name) if name in extra
        else F.col(name).cast(kind).alias(name) if name in present
        else F.lit(None).cast(kind).alias(name)
        for name, kind in names
    ])


def _standing(sons: DataFrame, moves: DataFrame) -> DataFrame:
    """(component, source, family_id, freed_by, step): where each named source stands now.

    A source's last known family is followed along the moves that families have made since. Few are left to
    follow, as every source that is named is written down with the family it ends up in.
    """
    at = materialize(sons.select("component", "source", "family_id", F.lit(None).cast("string").alias("freed_by"), "step"))
    settled = []
    while True:
        on = moves.withColumnRenamed("step", "_step").join(
            at.select("source", "component", "family_id", "step"), ["component", "family_id"]
        ).filter(F.col("_step") > F.col("step"))
        first = on.groupBy("component", "source").agg(F.min_by(F.struct("parent", "freed_by", "_step"), "_step").alias("_m"))
        moved = materialize(first.select(
            "component", "source",
            F.when(F.col("_m.freed_by").isNotNull(), F.col("source")).otherwise(F.col("_m.parent")).alias("family_id"),
            F.col("_m.freed_by").alias("freed_by"), F.col("_m._step").alias("step"),
        ))
        settled.append(at.join(moved.select("component", "source"), ["component", "source"], "left_anti"))
        if moved.isEmpty():
            return fan_in(*settled)
        at = moved


def _fold_in_blocks(rows: DataFrame, block_events: int) -> DataFrame:
    """Fold of components too large for one task, block after block in position order.

    A task sees the events of one block and the state of the ids they name. State is a log of changes: a block
    writes the families it opened or closed, the sources it named, and where the families it closed went. Sources it
    did not name move with their family and are looked up when they are named, so what a block writes does
    not grow with what came before.
    """
    spark = rows.sparkSession
    cuts = position_cuts(rows, "pos", block_events)
    rows = materialize(with_chunk(rows, "pos", cuts, "block"))
    family = "component string, family_id string, opened_by string, head string, size bigint, depth int, alive boolean"
    families = DeltaLog(spark, family, ("component", "family_id"))
    sons = DeltaLog(spark, "component string, source string, family_id string", ("component", "source"))
    moves = DeltaLog(spark, "component string, family_id string, parent string, freed_by string", ("component", "family_id"))
    facts = []
    for block in range(len(cuts) + 1):
        events = rows.filter(F.col("block") == block).drop("block")
        named = materialize(events.select("component", F.explode("ids").alias("name")).distinct())
        standing = materialize(_standing(sons.newest(named.withColumnRenamed("name", "source")), moves.rows()))
        # a split freed these while nobody named them
        freed = standing.filter("freed_by is not null").select(
            "component", F.col("source").alias("family_id"), F.col("freed_by").alias("opened_by"), F.col("source").alias("head"),
            F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("depth"), F.lit(True).alias("alive"), "step",
        )
        known = materialize(newest(
            families.newest(named.withColumnRenamed("name", "family_id")).unionByName(freed), families.keys
        ).filter("alive").drop("alive", "step"))
        state = _as_fold_input(
            known, stage=F.lit(0), kind=F.lit("FAMILY"), event_id=F.col("family_id")
        ).union(_as_fold_input(
            standing, stage=F.lit(0), kind=F.lit("SON"), event_id=F.col("source"), opened_by=F.col("family_id")
        ))
        out = materialize(_fold_rows(events.union(state), hand_over=True))
        facts.append(out.filter(F.col("fact").isin("OPEN", "CLOSE", "MISSING")))

        now = out.filter("fact = 'FAMILY'").select(
            "component", F.col("event_id").alias("family_id"), "opened_by", "head", "size", "depth", F.lit(True).alias("alive")
        )
        gone = known.join(now, ["component", "family_id"], "left_anti").withColumn("alive", F.lit(False))
        families.append(now.unionByName(gone), block)
        sons.append(out.filter("fact = 'SON'").select(
            "component", F.col("event_id").alias("source"), F.col("opened_by").alias("family_id")
        ), block)
        moves.append(out.filter("fact = 'MOVE'").select(
            "component", "family_id", "parent", F.col("opened_by").alias("freed_by")
        ), block)
    return fan_in(*facts)


def _merge_forest(closes: DataFrame, merges: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """Where versions stand in their merge tree: (node, tree, low), and (tree, ordinal, system_uuid) of the leaves.

    A node's place is the sum of the places on its way up. Ways are doubled, one row per node, so the
    rounds grow with the logarithm of the tree height and the rows not at all.
    """
    inside = closes.filter("parent is not null").withColumn("node", _node("family_id", "opened_by"))
    way = inside.select("node", _node("parent", "parent").alias("tree"), F.col("base").alias("low"))
    span = 1
    while span < height:
        above = way.select(F.col("node").alias("tree"), F.col("tree").alias("_tree"), F.col("low").alias("_low"))
        way = materialize(way.join(above, "tree", "left").select(
            "node", F.coalesce("_tree", "tree").alias("tree"), (F.col("low") + F.coalesce("_low", F.lit(0))).alias("low")
        ))
        span *= 2
    leaves = inside.filter("depth = 0").select("node", F.col("head").alias("system_uuid")).join(way, "node").select(
        "tree", F.col("low").alias("ordinal"), "system_uuid"
    )
    roots = merges.select("node").join(way, "node", "left_anti").select(
        "node", F.col("node").alias("tree"), F.lit(0).cast("bigint").alias("low")
    )
    return way.unionByName(roots), leaves


def lifecycle(
    control: DataFrame,
    block_events: int = BLOCK_EVENTS,
    version_rows_per_chunk: int = VERSION_ROWS_PER_CHUNK,
) -> Lifecycle:
    """Family versions and refused events of a whole control log (columns of ``CONTROL``)."""
    checked = materialize(_mark_repeated(validate(control)))
    held = checked.filter("reason is null")
    creates = held.filter("kind = 'CREATE'").select(
        F.col("event_id").alias("system_uuid"), F.col("sourceName").alias("sensor_id"),
        F.col("externalSystemID").alias("reports_id"), F.col("dataOffset").alias("data_offset"), *ORDER,
    )
    refers = held.filter("kind <> 'CREATE'").select("event_id", "kind", *ORDER, "ids")

    # An id that no event ever brings into being dooms the events naming it. They must not link
    # components; their other ids are only asked for being alive at that position.
    born = creates.select(F.col("system_uuid").alias("name")).union(
        refers.filter("kind = 'MERGE'").select(F.col("event_id").alias("name"))
    ).withColumn("_born", F.lit(True))
    mentions = materialize(
        refers.select("event_id", "kind", *ORDER, F.posexplode("ids").alias("list_index", "name"))
        .join(born, "name", "left")
    )
    doomed = mentions.filter("_born is null").select("event_id").distinct()
    sound = mentions.join(doomed, "event_id", "left_anti")
    components = component_labels(
        sound.filter("kind = 'MERGE'").select(F.col("event_id").alias("u"), F.col("name").alias("v"))
    )

    named = mentions.filter("_born").select("name").distinct()
    sound_events = refers.join(doomed, "event_id", "left_anti")
    probes = mentions.join(doomed, "event_id", "left_semi").filter("_born")
    anchored = fan_in(
        _as_fold_input(
            creates.join(named, creates.system_uuid == named.name, "left_semi"),
            kind=F.lit("CREATE"), event_id=F.col("system_uuid"), component=F.col("system_uuid"),
            stage=F.lit(1), ids=F.array("system_uuid"),
        ),
        _as_fold_input(
            sound_events, stage=F.lit(1),
            component=F.when(F.col("kind") == "MERGE", F.col("event_id")).otherwise(F.element_at("ids", 1)),
        ),
        _as_fold_input(
            probes, kind=F.lit("PROBE"), stage=F.lit(1), component=F.col("name"), ids=F.array("name"),
        ),
    )
    columns = anchored.columns
    rows = (
        anchored.withColumnRenamed("component", "node").join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node")).select(*columns)
    )
    if checked.count() + mentions.count() <= block_events:
        facts = _fold_rows(rows)
    else:
        rows = materialize(rows)
        large = materialize(
            rows.groupBy("component").count().filter(F.col("count") > block_events).select("component")
        )
        facts = _fold_rows(rows.join(large, "component", "left_anti").select(*columns))
        if not large.isEmpty():
            facts = facts.union(
                _fold_in_blocks(rows.join(large, "component", "left_semi").select(*columns), block_events)
            )
    facts = materialize(facts)
    versions, leaves, cuts = _versions(creates, facts, version_rows_per_chunk)
    sources = creates.select("system_uuid", "sensor_id", "reports_id", "data_offset")
    return Lifecycle(versions, leaves, materialize(sources), cuts, _rejected(checked, mentions, facts), components)


def _rejected(checked: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    never_born = mentions.filter("_born is null").select("event_id", "list_index", "name")
    absent = facts.filter("fact = 'MISSING'").select("event_id", "list_index", F.col("family_id").alias("name"))
    listed = mentions.select("event_id", "name", "list_index")
    # a probe carries one id, so its place in the list comes from the mention
    missing = never_born.union(
        absent.select("event_id", "name").join(listed, ["event_id", "name"]).select("event_id", "list_index", "name")
    )
    lost = missing.groupBy("event_id").agg(
        F.array_sort(F.collect_set(F.struct("list_index", "name")))["name"].alias("missing_ids")
    )
    return (
        checked.join(lost, "event_id", "left")
        .withColumn("missing_ids", F.when(F.col("reason").isNull(), F.col("missing_ids")))
        .withColumn("reason", F.coalesce("reason", F.when(F.col("missing_ids").isNotNull(), "UNKNOWN_ID")))
        .filter("reason is not null")
        .select("event_id", "kind", "pos", "topic", "offset", "event_key", "reason", "missing_ids")
    )


def _versions(creates: DataFrame, facts: DataFrame, rows_per_chunk: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """Written tables of versions and leaves, and the chunks in which a source's versions are put in order."""
    closes = facts.filter("fact = 'CLOSE'")
    opens = facts.filter("fact = 'OPEN'")
    merges = opens.filter("kind = 'MERGE'").withColumn("node", _node("family_id", "opened_by"))
    # an OPEN of a split carries the version it closed: its opener, first son and size
    splits = opens.filter("kind = 'SPLIT'").withColumn("node", _node("family_id", "opened_by"))
    height, turnover = opens.agg(
        F.max(F.when(F.col("kind") == "MERGE", F.col("depth"))), F.sum("size")
    ).first()
    places, leaves = map(materialize, _merge_forest(closes, merges, height or 0))

    taken = splits.select(
        "family_id", F.col("event_id").alias("opened_by"), *ORDER, F.lit("SON_TAKEN").alias("state"),
        F.col("head").alias("only"),
    )
    # a split frees all sons but the first
    parted = splits.filter("size > 1").join(places, "node").select(
        "tree", (F.col("low") + 1).alias("low"), (F.col("low") + F.col("size")).alias("high"), "event_id", *ORDER
    )
    freed = interval_join(leaves, parted, ["tree"], "ordinal", "low", "high").select(
        F.col("system_uuid").alias("family_id"), F.col("event_id").alias("opened_by"), *ORDER,
        F.lit("WAS_SPLIT").alias("state"), F.col("system_uuid").alias("only"),
    )
    # every member row but the CREATE ones comes from an opening and one of its sons
    cuts = position_cuts(opens, "pos", rows_per_chunk, turnover or 0)
    single = lambda rows: rows.withColumn("n_sons", F.lit(1).cast("bigint"))
    reopened = single(ordinal(taken.union(freed), ["family_id"], ORDER, "_nth", cuts)).withColumn(
        "version_seq", F.col("_nth") + 1
    ).drop("_nth")
    created = single(creates.select(
        F.col("system_uuid").alias("family_id"), F.col("system_uuid").alias("opened_by"), *ORDER,
        F.lit("NONE").alias("state"), F.lit(1).alias("version_seq"), F.col("system_uuid").alias("only"),
    ))
    merged = merges.join(places, "node").select(
        "family_id", "opened_by", *ORDER, F.lit("MERGED").alias("state"), F.lit(1).alias("version_seq"),
        F.col("size").alias("n_sons"), "tree", "low", (F.col("low") + F.col("size")).alias("high"),
    )
    ends = closes.select("family_id", "opened_by", F.col("pos").alias("v_to"))
    rows = fan_in(created, reopened, merged).join(ends, ["family_id", "opened_by"], "left")
    return materialize(rows), leaves, cuts


def _with_history(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """Adds each son's earlier version and which son stands for its source."""
    rows = rows.withColumn("_version", F.struct("family_id", "version_seq"))
    rows = previous_known(rows, ["system_uuid"], ORDER, "_version", "_prev", cuts)
    rows = ordinal(rows, ["system_uuid"], ORDER, "source_step", cuts)

    several = rows.filter("n_sons > 1")
    identity = ["family_id", "version_seq", "sensor_id", "reports_id"]
    lowest = several.groupBy(*identity).agg(F.min(F.struct("son_ordinal", "system_uuid")).alias("_low"))
    shaped = several.join(lowest, identity).unionByName(
        rows.filter("n_sons = 1").withColumn("_low", F.struct("son_ordinal", "system_uuid"))
    )
    return shaped.select(
        "*", F.col("_low.son_ordinal").alias("same_source_ordinal"), F.col("_low.system_uuid").alias("same_source_uuid"),
        F.col("_prev.family_id").alias("prev_family_id"), F.col("_prev.version_seq").alias("prev_version_seq"),
    ).select(*MEMBERSHIP_COLUMNS)

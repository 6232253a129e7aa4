"""Family fusion on a stream: one query over control events and reports.

Merges and splits move state between keys, so the state lives in tables that every micro-batch
reads and extends with the batch operators, instead of in one keyed stateful operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import families, routing
from ..operators.control import fan_in, validate
from ..operators.lifecycle import lifecycle
from ..plans.fusion import DEFAULT_SEEDS
from ..schemas import CONTROL, REPORT
from ..session import scratch
from ..sinks.files import for_each_batch
from .state import SCHEMAS, StateTables

_CONTROL = [field.name for field in CONTROL.fields]
_REPORT = [field.name for field in REPORT.fields]
VERSION = list(families.VERSION)


def unified(control: DataFrame, reports: DataFrame) -> DataFrame:
    """Control events and reports in one stream; reports have the kind REPORT."""
    return fan_in(control, reports.withColumn("kind", F.lit("REPORT")))


def _as_given(rows: DataFrame, shift: int, seen: int, past: DataFrame | None) -> DataFrame:
    """Adds ``event_pos``: where a report of this batch stood before it was moved on, or one of the history."""
    given = F.col("pos") - shift
    if past is None or not shift:
        return rows.withColumn("event_pos", given)
    told = past.select("topic", "offset", "pos", F.col("event_pos").alias("_told")).distinct()
    return rows.join(told, ["topic", "offset", "pos"], "left").withColumn(
        "event_pos", F.when(F.col("pos") > seen, given).otherwise(F.col("_told"))
    ).drop("_told")


class FusionStream:
    """foreachBatch step with its state (K5); ``start`` runs it as a named query.

    Rows take effect in the order (batch, position): a batch comes after all earlier ones, and inside it control
    events and reports stand in their total order. ``pos`` is that order as one number. As long as nothing
    comes late it is the position itself; a batch that begins at or below what was seen is moved on as a
    whole, by as much as puts its first row right above everything seen, and so are the batches after it.
    What comes late thus meets the families that are live on its arrival, before what else its batch holds at higher
    positions. ``event_pos`` keeps what an event or report said. So updates and refusals are those of
    a batch run over the moved positions, and those of one over the log itself where nothing is late.

    ``publish`` is handed the stored records of a batch and its number; it may be called again for a
    batch that is run again.
    """

    def __init__(self, spark: SparkSession, folder: str, mode: str = "resume", seeds: str | None = None,
                 compact_every: int = 50, publish: Callable[[DataFrame, int], None] | None = None):
        self.state = StateTables(spark, folder, compact_every)
        self.publish = publish
        self.mode = mode
        self.seed_rule = seeds or DEFAULT_SEEDS[mode]

    def start(self, rows: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Start the query over ``unified`` rows; ``trigger`` as in ``DataStreamWriter.trigger``."""
        return for_each_batch(rows, self.step, checkpoint, name=name, **trigger)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            with scratch(batch.sparkSession):
                self._step(batch, batch_id)
            self.state.prune(batch_id)
        finally:
            batch.unpersist()
        if self.publish:
            self.publish(self.state.output("updates", batch_id), batch_id)

    def _step(self, batch: DataFrame, batch_id: int) -> None:
        state = self.state
        seen, shift = state.arrival(batch_id)
        first, last = batch.agg(F.min("pos"), F.max("pos")).first()
        if first is not None:
            shift = max(shift, seen + 1 - first)
        moved = batch.withColumn("event_pos", F.col("pos")).withColumn("pos", F.col("pos") + shift)
        control = moved.filter("kind <> 'REPORT'").select(*_CONTROL, "event_pos")
        reports = moved.filter("kind = 'REPORT'").select(*_REPORT, "event_pos")

        changed, rejected = self._apply(control, batch_id)
        before = state.current("members", batch_id)
        members = before if changed is None else before.join(
            changed.select("system_uuid").distinct(), "system_uuid", "left_anti"
        ).unionByName(changed)
        listening = members.filter(F.col("v_to").isNull() | (F.col("v_to") > seen)).persist()

        routed = routing.route(reports, listening, self.mode)
        opened = listening.filter(F.col("v_from") > seen)
        past = None
        if self.mode == "replay" and changed is not None and not opened.isEmpty():
            # a version opened now reads its sons from the start: the history it missed
            past = state.history(batch_id, opened.select(F.col("sensor_id").alias("topic")))
            routed = routed.unionByName(routing.route(past, opened, "replay"))
        routed = routed.persist()

        told = state.current("sons", batch_id)
        reported = told.filter(F.col("pos").isNotNull())
        heirs = opened.select("system_uuid").distinct()
        seeds = families.seeds(
            routed, members.join(heirs, "system_uuid", "left_semi"), self.seed_rule,
            known=reported.join(heirs, "system_uuid", "left_semi"),
        ).join(opened.select(*VERSION).distinct(), VERSION, "left_semi").persist()
        start = seeds.unionByName(
            told.join(listening.select(*VERSION).distinct(), VERSION, "left_semi")
            .select(*VERSION, "system_uuid", F.col("attributes").alias("seed"))
        )
        records = families.family_records(
            routed, listening, start, started=reported.select(*VERSION).distinct()
        )

        state.put_output("updates", _as_given(records, shift, seen, past), batch_id)
        state.put_output("rejected_reports", _as_given(routing.rejected(routed), shift, seen, past), batch_id)
        state.put_output("rejected_events", rejected.withColumn("event_pos", F.col("pos") - shift), batch_id)
        latest = families.son_latest(routed)
        unheard = seeds.join(latest, [*VERSION, "system_uuid"], "left_anti").select(
            *VERSION, "system_uuid",
            *[F.lit(None).cast(SCHEMAS["sons"][name].dataType).alias(name) for name in routing.RECORD_ORDER],
            F.col("seed").alias("attributes"),
        )
        state.put("sons", latest.unionByName(unheard), batch_id)
        if self.mode == "replay":
            state.put_history(reports, batch_id)
        top = seen if last is None else max(seen, last + shift)
        state.put("marks", batch.sparkSession.createDataFrame([(top, shift)], SCHEMAS["marks"]), batch_id)
        for frame in (routed, seeds, listening):
            frame.unpersist()

    def _apply(self, control: DataFrame, batch_id: int) -> tuple[DataFrame | None, DataFrame]:
        """Lifecycle of the genealogies the new events touch; None where there are no events."""
        state = self.state
        past = state.current("control", batch_id)
        new = validate(control).select(*_CONTROL, "event_pos", "event_id", "ids")
        repeated = new.join(past.select("event_id"), "event_id", "left_semi").select(
            "event_id", "kind", "pos", "topic", "offset", "event_key", F.lit("DUPLICATE_EVENT").alias("reason"),
            F.lit(None).cast("array<string>").alias("missing_ids"),
        )
        if control.isEmpty():
            state.put("control", past.limit(0), batch_id)
            state.put("members", state.current("members", batch_id).limit(0), batch_id)
            return None, repeated
        fresh = new.join(past.select("event_id"), "event_id", "left_anti")
        named = fresh.filter("kind in ('MERGE', 'SPLIT')").select(F.explode("ids").alias("event_id")).distinct()
        held = past.filter("accepted")
        touched = held.join(named, "event_id", "left_semi").select("component").distinct()
        history = held.join(touched, "component", "left_semi")
        events = history.select(*_CONTROL, "event_pos", "event_id").unionByName(
            fresh.select(*_CONTROL, "event_pos", "event_id")
        )
        life = lifecycle(events.select(*_CONTROL))

        anchor = F.when(F.col("kind") == "SPLIT", F.lower("splittedEntityID")).otherwise(F.col("event_id"))
        refused = life.rejected.filter("reason <> 'DUPLICATE_EVENT'").select("event_id").withColumn("_refused", F.lit(True))
        # the same key twice inside one batch: only the first is an event
        repeats = life.rejected.filter("reason = 'DUPLICATE_EVENT'").select("event_id", "pos", "topic", "offset")
        events = events.join(repeats, ["event_id", "pos", "topic", "offset"], "left_anti")
        labelled = (
            events.withColumn("node", anchor).join(life.components, "node", "left")
            .withColumn("component", F.coalesce("component", "node"))
            .join(refused, "event_id", "left").withColumn("accepted", F.col("_refused").isNull())
        )
        state.put("control", labelled, batch_id)
        state.put("members", life.members, batch_id)
        return life.members, life.rejected.unionByName(repeated)

"""Streamed records equal the batch records, also after a crash in the middle of a batch."""

import pytest
from pyspark.sql import functions as F

from kinweave.schemas import CONTROL, REPORT
from kinweave.sources.generators import SAMPLE_WORDS, random_int_stream
from kinweave.streaming import control as queries
from kinweave.streaming.engine import FusionStream, unified
from kinweave.streaming.latest import latest_per_source

from .logs import control_frame, random_control, random_reports, reports_frame
from .model import Registry, records
from .test_families import dead_rows, record_rows


def write_batches(spark, folder, events, reports, cuts):
    """One parquet file per micro-batch, in position order."""
    rows = unified(control_frame(spark, events), reports_frame(spark, reports))
    edges = [-1, *cuts, 10**9]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = rows.filter((F.col("pos") > low) & (F.col("pos") <= high))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return rows.schema


def stream(spark, folder, schema):
    return queries.throttled_files(spark, f"{folder}/*", schema)


def run(spark, engine, folder, schema, checkpoint, n):
    for i in range(n):  # files are offered one by one, so every batch is one file
        rows = spark.readStream.schema(schema).parquet(f"{folder}/{{{','.join(f'{j:03d}' for j in range(i + 1))},none}}")
        query = engine.start(rows, "fusion", checkpoint, availableNow=True)
        query.awaitTermination()


@pytest.mark.parametrize("mode,cuts,compact", [("resume", [30], 50), ("replay", [15, 35], 2)])
def test_stream_equals_batch(spark, tmp_path, mode, cuts, compact):
    events, reports = random_control(21, n_events=50), random_reports(21)
    schema = write_batches(spark, tmp_path / "in", events, reports, cuts)
    engine = FusionStream(spark, str(tmp_path / "state"), mode, compact_every=compact)
    run(spark, engine, tmp_path / "in", schema, str(tmp_path / "ckpt"), len(cuts) + 1)
    model = Registry(events)
    wanted, dead = records(model, reports, mode, engine.seed_rule)
    assert record_rows(engine.state.read("updates")) == wanted
    assert dead_rows(engine.state.read("rejected_reports")) == dead
    refused = {(r.pos, r.offset, r.kind): (r.reason, r.missing_ids or []) for r in engine.state.read("rejected_events").collect()}
    assert refused == model.rejected


def test_crash_between_state_and_commit(spark, tmp_path):
    """A batch that dies after writing some of its state is run again with the same result."""
    events, reports = random_control(22, n_events=40), random_reports(22)
    schema = write_batches(spark, tmp_path / "in", events, reports, [25])
    engine = FusionStream(spark, str(tmp_path / "state"), "resume")
    run(spark, engine, tmp_path / "in", schema, str(tmp_path / "ckpt"), 1)

    put, calls = engine.state.put, []

    def dies(name, rows, batch_id):
        put(name, rows, batch_id)
        calls.append(name)
        if name == "sons":
            raise RuntimeError("lost")

    engine.state.put = dies
    with pytest.raises(Exception, match="lost"):
        run(spark, engine, tmp_path / "in", schema, str(tmp_path / "ckpt"), 2)
    assert "sons" in calls
    again = FusionStream(spark, str(tmp_path / "state"), "resume")
    run(spark, again, tmp_path / "in", schema, str(tmp_path / "ckpt"), 2)
    wanted, dead = records(Registry(events), reports, "resume", "carry")
    assert record_rows(again.state.read("updates")) == wanted
    assert dead_rows(again.state.read("rejected_reports")) == dead


def test_late_control_event_takes_effect_on_arrival(spark, tmp_path):
    from .logs import create

    engine = FusionStream(spark, str(tmp_path / "state"), "resume")
    first = unified(control_frame(spark, [create(1, "t0", "x0", key="a")]), reports_frame(spark, [("t0", 50, 50, "t0", "x0")]))
    late = unified(control_frame(spark, [create(2, "t1", "x0", key="b")]), reports_frame(spark, [("t1", 60, 60, "t1", "x0")]))
    engine.step(first, 0)
    engine.step(late, 1)
    rows = engine.state.current("control", 2).select("event_pos", "pos").collect()
    assert sorted(map(tuple, rows)) == [(1, 1), (2, 51)]
    assert engine.state.read("updates").count() == 2


def folders(spark, path):
    import os

    return sum(len(names) for _, names, _ in os.walk(path))


def test_late_report_reaches_the_live_family(spark, tmp_path):
    """A report of a merged source comes at a position before the merge, after a batch that held the merge."""
    from .logs import create, event_id, merge

    creates = [create(1, "t0", "x0", key="a"), create(2, "t1", "x1", key="b")]
    joined = merge(3, [event_id(e) for e in creates], key="m")
    engine = FusionStream(spark, str(tmp_path / "state"), "resume")
    engine.step(unified(control_frame(spark, [*creates, joined]), reports_frame(spark, [("t1", 9, 9, "t1", "x1")])), 0)
    told = []
    engine.publish = lambda records, batch: told.append((batch, records.count()))
    engine.step(unified(control_frame(spark, []), reports_frame(spark, [("t0", 2, 2, "t0", "x0")])), 1)
    updates = engine.state.read("updates").collect()
    assert [r.entityID for r in updates] == [event_id(joined)] * 2 and told == [(1, 1)]
    assert engine.state.read("rejected_reports").count() == 0


def test_late_control_events_keep_their_order(spark, tmp_path):
    """A split and then a merge of its two results, both late: the merge still comes second."""
    from .logs import create, event_id, merge, split

    creates = [create(1, "t0", "x0", key="a"), create(2, "t1", "x1", key="b")]
    ids = [event_id(e) for e in creates]
    joined = merge(3, ids, key="m")
    engine = FusionStream(spark, str(tmp_path / "state"), "resume")
    engine.step(unified(control_frame(spark, [*creates, joined]), reports_frame(spark, [("t1", 90, 90, "t1", "x1")])), 0)
    late = [split(10, event_id(joined), key="s"), merge(11, [event_id(joined), ids[1]], key="n")]
    engine.step(unified(control_frame(spark, late), reports_frame(spark, [("t0", 95, 95, "t0", "x0")])), 1)
    assert engine.state.read("rejected_events").count() == 0
    live = engine.state.current("members", 2).filter("v_to is null").select("family_id").distinct().collect()
    assert [r.family_id for r in live] == [event_id(late[1])]
    rows = engine.state.current("control", 2).select("event_pos", "pos").collect()
    assert {(r.event_pos, r.pos) for r in rows if r.event_pos >= 10} == {(10, 91), (11, 92)}


def test_batches_leave_no_tables_behind(spark, tmp_path):
    from kinweave.session import checkpoint_dir

    from .logs import create

    engine = FusionStream(spark, str(tmp_path / "state"), "resume", compact_every=2)
    root = checkpoint_dir(spark).removeprefix("file:")
    before = folders(spark, root)
    for i in range(7):
        rows = unified(control_frame(spark, [create(i + 1, "t0", f"x{i}", key=f"k{i}")]), reports_frame(spark, [("t0", i + 2, i + 2, "t0", f"x{i}")]))
        engine.step(rows, i)
    assert folders(spark, root) == before
    assert folders(spark, tmp_path / "state" / "members") <= 4
    assert engine.state.current("members", 7).count() == 7 and engine.state.read("updates").count() == 7


def test_latest_per_source(spark, tmp_path):
    reports = random_reports(5)
    reports_frame(spark, reports).repartition(4).write.parquet(str(tmp_path / "r"))
    rows = latest_per_source(queries.throttled_files(spark, str(tmp_path / "r"), REPORT, 2))
    query = rows.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.topic, r.external_id): r.pos for r in spark.table("latest").collect()}
    want = {}
    for topic, _, pos, _, ext in reports:
        want[topic, ext] = max(pos, want.get((topic, ext), -1))
    assert got == want


def test_named_queries_stop_one_by_one(spark):
    """One running pipeline per word; killing one leaves the others."""
    for name in SAMPLE_WORDS.split():
        random_int_stream(spark, 5).writeStream.format("memory").queryName(name).start()
    try:
        assert queries.stop(spark, "B") and not queries.stop(spark, "B")
        assert queries.running(spark, "B") is None
        assert queries.running(spark, "A").isActive and queries.running(spark, "C").isActive
    finally:
        for name in "AC":
            queries.stop(spark, name)


def test_throttle(spark):
    assert all(queries.throttled_rate(spark, ms).isStreaming for ms in queries.SAMPLE_INTERVALS_MS)
    rate = queries.throttled_rate(spark, 250)
    assert rate.isStreaming and queries.every(250) == {"processingTime": "250 milliseconds"}
    with pytest.raises(ValueError):
        queries.throttled_rate(spark, 300)
    assert CONTROL.fieldNames()[0] == "pos"


def test_late_and_timely_events_of_one_batch(spark, tmp_path):
    """Late CREATE, CREATE and MERGE, and a timely SPLIT of that merge: all hold, as in a batch run."""
    from .logs import create, event_id, merge, split

    engine = FusionStream(spark, str(tmp_path / "state"), "resume")
    first = [create(1, "t9", "x9", key="z")]
    engine.step(unified(control_frame(spark, first), reports_frame(spark, [("t9", 100, 100, "t9", "x9")])), 0)
    late = [create(3, "t0", "x0", key="a"), create(4, "t1", "x1", key="b")]
    late.append(merge(5, [event_id(e) for e in late], key="m"))
    late.append(split(102, event_id(late[2]), key="s"))
    engine.step(unified(control_frame(spark, late), reports_frame(spark, [("t0", 101, 101, "t0", "x0"), ("t0", 103, 103, "t0", "x0")])), 1)
    assert engine.state.read("rejected_events").count() == 0
    rows = sorted((r.event_pos, r.entityID, r.version_seq, r.stateChanges) for r in engine.state.read("updates").collect())
    assert rows[:-2] == [(100, event_id(first[0]), 1, "NONE")]
    assert rows[-2:] == [(101, event_id(late[2]), 1, "MERGED"), (103, event_id(late[2]), 2, "SON_TAKEN")]


def test_late_reports_keep_their_order(spark, tmp_path):
    """Of two late reports of one family the later one is its last word, whatever the topics are called."""
    from .logs import create, event_id, merge

    creates = [create(1, "t0", "x0", key="a"), create(2, "t1", "x1", key="b")]
    joined = merge(3, [event_id(e) for e in creates], key="m")
    engine = FusionStream(spark, str(tmp_path / "state"), "resume")
    engine.step(unified(control_frame(spark, [*creates, joined]), reports_frame(spark, [("t1", 100, 100, "t1", "x1")])), 0)
    engine.step(unified(control_frame(spark, []), reports_frame(spark, [("t1", 50, 50, "t1", "x1"), ("t0", 60, 60, "t0", "x0")])), 1)
    rows = engine.state.output("updates", 1).orderBy("pos").collect()
    assert [r.event_pos for r in rows] == [50, 60]
    assert [s.entityAttributes.basicAttributes.entityOffset for s in rows[-1].sons] == [60, 50]


@pytest.mark.parametrize("mode,seed", [("resume", 31), ("replay", 32)])
def test_any_arrival_order(spark, tmp_path, mode, seed):
    """Events and reports dealt to batches at random: what a batch run gives over the order of arrival."""
    import random

    rng = random.Random(seed)
    events, reports = random_control(seed, n_events=36), random_reports(seed, n=50, last_pos=45)
    # an event repeated by the sender arrives with the first of its key, as only that one can be told apart
    dealt = {}
    event_batch = [dealt.setdefault(e["event_key"], rng.randrange(3)) for e in events]
    report_batch = [rng.randrange(3) for _ in reports]
    engine = FusionStream(spark, str(tmp_path / "state"), mode)
    seen, shift, moved_events, moved_reports, given = -1, 0, [], [], {}
    for batch in range(3):
        own = [e for e, b in zip(events, event_batch) if b == batch]
        heard = [r for r, b in zip(reports, report_batch) if b == batch]
        engine.step(unified(control_frame(spark, own), reports_frame(spark, heard)), batch)
        positions = [e["pos"] for e in own] + [r[2] for r in heard]
        shift = max(shift, seen + 1 - min(positions))
        seen = max(positions) + shift
        moved_events += [dict(e, pos=e["pos"] + shift) for e in own]
        moved_reports += [(t, o, p + shift, s, x) for t, o, p, s, x in heard]
        given.update({(t, o, p + shift): p for t, o, p, _, _ in heard})
    model = Registry(moved_events)
    wanted, dead = records(model, moved_reports, mode, engine.seed_rule)
    updates = engine.state.read("updates")
    # sons' states tell where a report is from, so they are compared by that position
    told = {p: q for (_, _, p), q in given.items()}
    shown = sorted((r.entityID, r.version_seq, r.pos, r.topic, r.offset, r.stateChanges, r.event_pos,
                    tuple((s.entityID, s.entityAttributes and s.entityAttributes.basicAttributes.entityOffset) for s in r.sons))
                   for r in updates.collect())
    assert shown == sorted((*r[:5], r[7], given[r[3], r[4], r[2]], tuple((s, p if p is None else told[p]) for s, p in r[8])) for r in wanted)
    assert dead_rows(engine.state.read("rejected_reports")) == dead
    refused = {(r.pos, r.offset, r.kind): (r.reason, r.missing_ids or []) for r in engine.state.read("rejected_events").collect()}
    assert refused == model.rejected


def test_history_is_read_only_where_a_version_opened(spark, tmp_path, monkeypatch):
    from .logs import create, event_id, merge

    creates = [create(1, "t0", "x0", key="a"), create(2, "t1", "x1", key="b"), create(3, "t2", "x2", key="c")]
    engine = FusionStream(spark, str(tmp_path / "state"), "replay")
    asked = []
    history = engine.state.history
    monkeypatch.setattr(engine.state, "history", lambda batch, topics: asked.append(history(batch, topics)) or asked[-1])
    told = [(f"t{i}", 10, 10, f"t{i}", f"x{i}") for i in range(3)]
    engine.step(unified(control_frame(spark, creates), reports_frame(spark, told)), 0)
    asked.clear()
    engine.step(unified(control_frame(spark, []), reports_frame(spark, [("t0", 20, 20, "t0", "x0")])), 1)
    assert not asked
    joined = merge(30, [event_id(e) for e in creates[:2]], key="m")
    engine.step(unified(control_frame(spark, [joined]), reports_frame(spark, [])), 2)
    from kinweave.streaming.state import topic_bucket

    buckets = {r[0] for r in spark.createDataFrame([("t0",), ("t1",)], "topic string").select(topic_bucket(F.col("topic"))).collect()}
    plan = asked[0]._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(str(b) in pruned.split("bucket")[-1] for b in buckets) and "PushedFilters" in plan
    assert engine.state.output("updates", 2).count() == 3

"""Routing and report fold against the sequential model, and the demo scenario."""

import pytest
from pyspark.sql import functions as F

from kinweave.operators import families, routing
from kinweave.operators.lifecycle import lifecycle
from kinweave.plans.fusion import fuse

from .logs import control_frame, create, event_id, merge, random_control, random_reports, reports_frame, split
from .model import Registry, records


def record_rows(frame):
    known = F.transform("sons", lambda s: F.struct(
        s["entityID"], s["entityAttributes"]["basicAttributes"]["entityOffset"]))
    rows = frame.select(
        "entityID", "version_seq", "pos", "topic", "offset", "sub_ordinal", "reporter_uuid", "stateChanges",
        known.alias("sons"), F.col("entityAttributes.basicAttributes.entityOffset").alias("own"), "complete",
    ).collect()
    for r in rows:
        assert r.own == r.pos
        assert r.complete == all(s[1] is not None for s in r.sons)
    return sorted((*r[:8], tuple(tuple(s) for s in r.sons)) for r in rows)


def dead_rows(frame):
    return sorted((r.family_id, r.version_seq, r.pos, r.topic, r.offset) for r in frame.collect())


CASES = [("replay", "own"), ("resume", "carry"), ("replay", "none"), ("resume", "own"), ("replay", "carry")]


@pytest.mark.parametrize("seed", [1, 2])
def test_records_of_random_logs(spark, seed):
    events, reports = random_control(seed, n_events=50), random_reports(seed)
    life, model = lifecycle(control_frame(spark, events)), Registry(events)
    frame = reports_frame(spark, reports)
    for mode, seeds in CASES:
        routed = routing.route(frame, life.members, mode)
        wanted, dead = records(model, reports, mode, seeds)
        seed_rows = families.seeds(routed, life.members, seeds)
        assert record_rows(families.family_records(routed, life.members, seed_rows)) == wanted
        assert dead_rows(routing.rejected(routed)) == dead


@pytest.mark.parametrize("mode,seeds", CASES[:2])
def test_hot_families_and_sources_in_chunks(spark, mode, seeds):
    """Tiny limits force the paths for hot keys; the records stay the same."""
    events, reports = random_control(3, n_events=60, n_topics=2, n_ids=1), random_reports(3, n_topics=2, n_ids=1)
    life, model = lifecycle(control_frame(spark, events)), Registry(events)
    routed = routing.route(reports_frame(spark, reports), life.members, mode, few=1)
    seed_rows = families.seeds(routed, life.members, seeds, rows_per_chunk=4)
    got = families.family_records(routed, life.members, seed_rows, record_sons_per_chunk=40)
    wanted, dead = records(model, reports, mode, seeds)
    assert record_rows(got) == wanted
    assert dead_rows(routing.rejected(routed)) == dead


def scenario():
    a, b = create(1, "source1", "id1"), create(2, "source2", "id1")
    m = merge(5, [event_id(a), event_id(b)])
    events = [a, b, m, split(8, event_id(m))]
    reports = [("source1", 0, 3, "source1", "id1"), ("source2", 0, 4, "source1", "id1")]
    reports += [("source1", offset, pos, "source1", "id1") for offset, pos in ((1, 6), (2, 7), (3, 9), (4, 10))]
    return events, reports, event_id(a), event_id(b), event_id(m)


def test_demo_scenario_replay(spark):
    events, reports, a, b, m = scenario()
    out = fuse(control_frame(spark, events), reports_frame(spark, reports), "replay")
    rows = record_rows(out.records)
    assert [(r[0], r[1], r[2], r[7]) for r in rows if r[0] == a] == [(a, 1, 3, "NONE")]
    assert [(r[1], r[2], r[3], r[7]) for r in rows if r[0] == m] == [
        (1, 3, "source1", "MERGED"), (1, 4, "source2", "NONE"), (1, 6, "source1", "NONE"), (1, 7, "source1", "NONE"),
        (2, 3, "source1", "SON_TAKEN"), (2, 6, "source1", "NONE"), (2, 7, "source1", "NONE"), (2, 9, "source1", "NONE"),
        (2, 10, "source1", "NONE"),
    ]
    assert len(rows) == 10
    # son B is never heard: it stays listed, without attributes
    assert all(r[8][1] == (b, None) for r in rows if r[0] == m and r[1] == 1)
    assert dead_rows(out.rejected_reports) == [(b, 1, 4, "source2", 0), (b, 2, 4, "source2", 0)]


def test_demo_scenario_resume(spark):
    events, reports, a, b, m = scenario()
    out = fuse(control_frame(spark, events), reports_frame(spark, reports), "resume")
    rows = record_rows(out.records)
    assert [(r[0], r[1], r[2], r[7]) for r in rows] == sorted([
        (a, 1, 3, "NONE"), (m, 1, 6, "MERGED"), (m, 1, 7, "NONE"), (m, 2, 9, "SON_TAKEN"), (m, 2, 10, "NONE"),
    ])
    assert dead_rows(out.rejected_reports) == [(b, 1, 4, "source2", 0)]


@pytest.mark.parametrize("mode", ["replay", "resume"])
def test_snapshot_is_the_last_record(spark, mode):
    events, reports = random_control(7, n_events=50), random_reports(7)
    out = fuse(control_frame(spark, events), reports_frame(spark, reports), mode)
    model = Registry(events)
    wanted, _ = records(model, reports, mode, {"replay": "own", "resume": "carry"}[mode])
    last = {}
    for r in sorted(wanted, key=lambda r: (r[0], r[1], r[2], r[3], r[4], r[5])):
        last[r[0]] = r
    got = {}
    for r in out.snapshot.collect():
        offset = r.son_attributes.basicAttributes.entityOffset if r.son_attributes else None
        got.setdefault((r.entityID, r.version_seq, r.pos, r.topic, r.offset, r.sub_ordinal, r.preferred_uuid, r.live), []).append(
            (r.son_ordinal, r.son_id, offset))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {
        (*r[:7], r[0] in model.live): list(r[8]) for r in last.values()
    }


def test_unknown_mode_and_seeds(spark):
    events, reports, *_ = scenario()
    life = lifecycle(control_frame(spark, events))
    with pytest.raises(ValueError):
        routing.route(reports_frame(spark, reports), life.members, "sideways")
    routed = routing.route(reports_frame(spark, reports), life.members, "replay")
    with pytest.raises(ValueError):
        families.seeds(routed, life.members, "all")

"""Family lifecycle against the sequential model."""

import pytest
from pyspark.sql import functions as F

from kinweave.operators import registry as views
from kinweave.operators.components import component_labels
from kinweave.operators.lifecycle import lifecycle

from .logs import control_frame, create, event_id, merge, random_control, split
from .model import Registry, uuid_of

COLUMNS = ["family_id", "version_seq", "state", "v_from", "v_to", "n_sons", "son_ordinal", "system_uuid",
           "sensor_id", "reports_id", "data_offset"]


def member_rows(life):
    return sorted((tuple(r) for r in life.members.select(*COLUMNS).collect()))


def rejected_rows(life):
    return {
        (r.pos, r.offset, r.kind): (r.reason, r.missing_ids or [])
        for r in life.rejected.collect()
    }


def check(spark, events, **limits):
    life, model = lifecycle(control_frame(spark, events), **limits), Registry(events)
    assert member_rows(life) == model.rows()
    assert rejected_rows(life) == model.rejected
    return life


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    check(spark, random_control(seed))


@pytest.mark.parametrize("seed,block", [(11, 3), (12, 7), (13, 15)])
def test_large_components_fold_in_blocks(spark, seed, block):
    """Components beyond the block size keep their state in tables between blocks."""
    check(spark, random_control(seed), block_events=block, version_rows_per_chunk=5)


def test_blocks_write_what_moved(spark, monkeypatch):
    """A family of 40 is dissolved unnamed; blocks that name two or three ids write a few rows each, not the 40."""
    from kinweave.operators import lifecycle as module

    written = []
    append = module.DeltaLog.append
    monkeypatch.setattr(module.DeltaLog, "append", lambda self, rows, step: (written.append((step, rows.count())), append(self, rows, step))[1])
    creates = [create(i, "t0", f"x{i}", key=f"c{i}") for i in range(40)]
    ids = [event_id(e) for e in creates]
    whole = merge(100, ids, key="whole")
    events = [*creates, whole, split(101, event_id(whole), key="apart")]
    # ids freed without being named since
    pairs = [merge(200 + i, [ids[2 * i + 1], ids[2 * i + 2]], key=f"p{i}") for i in range(19)]
    events += pairs + [split(300 + i, event_id(p), key=f"again{i}") for i, p in enumerate(pairs)]
    check(spark, events, block_events=12)
    last = max(step for step, _ in written)
    assert last >= 5 and all(n <= 24 for step, n in written if step == last)


def test_deep_merge_chain(spark):
    """A family that grows by one source per event, then falls apart."""
    creates = [create(i, "t0", f"x{i}", key=f"c{i}") for i in range(12)]
    events, top = list(creates), event_id(creates[0])
    for i in range(1, 12):
        m = merge(100 + i, [top, event_id(creates[i])])
        events.append(m)
        top = event_id(m)
    events.append(split(200, top))
    events.append(split(201, event_id(creates[5])))
    check(spark, events)
    check(spark, events, block_events=4, version_rows_per_chunk=6)


def test_chained_merges_are_stored_in_linear_rows(spark):
    """2000 merges, each of the family so far and one more source: two million public rows, a few thousand stored ones."""
    n = 2000
    creates = [create(i, "t0", f"x{i}", key=f"c{i}") for i in range(n + 1)]
    ids = [event_id(e) for e in creates]
    events, top = list(creates), ids[0]
    for i in range(1, n + 1):
        m = merge(10_000 + i, [top, ids[i]], key=f"m{i}")
        events.append(m)
        top = event_id(m)
    life = lifecycle(control_frame(spark, events))
    assert life.versions.count() == 2 * n + 1 and life.leaves.count() == n + 1
    assert "members" not in life.__dict__
    # the sons of the k-th merge are the first k + 1 sources, in order
    place = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "system_uuid string, place int")
    got = life.sons().join(place, "system_uuid").groupBy("family_id", "state", "n_sons").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("son_ordinal").alias("ordinals"),
        F.max(F.when(F.col("state") == "MERGED", F.abs(F.col("place") - F.col("son_ordinal"))).otherwise(0)).alias("off"),
    ).collect()
    assert len(got) == 2 * n + 1 and all(r["rows"] == r.n_sons == r.ordinals and r.off == 0 for r in got)
    assert sorted(r.n_sons for r in got if r.state == "MERGED") == list(range(2, n + 2))
    live = views.current(life.sons())
    assert live.count() == n + 1 and live.select("family_id").distinct().count() == 1


def test_version_facts(spark):
    life = check(spark, random_control(99, n_events=80))
    live = views.current(life.members)
    sources = views.sources(life.members)
    assert live.count() == live.select("system_uuid").distinct().count() == sources.count()
    own = live.join(sources.select(F.col("system_uuid").alias("family_id")), "family_id", "left_semi")
    assert own.filter("family_id = system_uuid").count() == own.select("family_id").distinct().count()


def test_as_of(spark):
    events = random_control(5)
    life, model = lifecycle(control_frame(spark, events)), Registry(events)
    for position in (0, 10, 25, 40, 10_000):
        got = {(r.family_id, r.version_seq) for r in views.as_of(life.members, position).collect()}
        assert got == {
            (v["family"], v["seq"]) for v in model.versions
            if v["v_from"] <= position and (v["v_to"] is None or v["v_to"] > position)
        }


def test_reasons_in_order(spark):
    a, b = create(1, "t0", "x0"), create(2, "t1", "x0")
    ids = [event_id(a), event_id(b)]
    nobody = uuid_of("nobody")
    events = [
        a, b, merge(3, [ids[0], "not-a-uuid", ids[0]]), merge(4, []), merge(5, [ids[0], nobody, ids[0]]),
        merge(6, [ids[1], nobody]), split(7, nobody), split(8, ids[0]), merge(9, [ids[0]]), merge(10, ids),
    ]
    life = check(spark, events)
    reasons = {r.pos: r.reason for r in life.rejected.collect()}
    assert reasons == {3: "MALFORMED_ID", 4: "EMPTY_LIST", 5: "DUPLICATE_ID", 6: "UNKNOWN_ID", 7: "UNKNOWN_ID",
                       10: "UNKNOWN_ID"}


def test_empty_control_log(spark):
    life = lifecycle(control_frame(spark, []))
    assert life.members.count() == 0 and life.rejected.count() == 0


def test_component_labels_of_path_and_cycle(spark):
    path = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    ring = [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z9", "z9")]
    labels = component_labels(spark.createDataFrame(path + ring, "u string, v string"))
    got = {r.node: r.component for r in labels.collect()}
    assert got == {**{f"n{i:02d}": "n00" for i in range(21)}, "z1": "z1", "z2": "z1", "z3": "z1"}
    assert labels.count() == len(got)

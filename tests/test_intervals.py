"""Range joins against brute force, and routing to sources with very many versions."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import routing
from kinweave.operators.intervals import interval_join
from kinweave.operators.lifecycle import lifecycle
from kinweave.plans.fusion import Fusion
from kinweave.sources.bindings import b1_control, b1_reports, table

from .logs import control_frame, random_control, random_reports, reports_frame
from .model import Registry, records
from .test_families import dead_rows

POINTS, SPANS = "k string, p bigint, name int", "k string, a bigint, b bigint, own int"


@pytest.mark.parametrize("few", [0, 4])
def test_points_meet_the_intervals_that_hold_them(spark, few):
    rng = random.Random(few)
    points = [(rng.choice("abcd"), rng.choice([rng.randrange(-50, 400), rng.randrange(1 << 40)]), i) for i in range(400)]
    spans = []
    for i in range(300):
        low = rng.choice([None, rng.randrange(-60, 400), rng.randrange(1 << 40)])
        width = rng.choice([0, 1, 2, 15, 16, 17, 300, 1 << 33])
        high = None if rng.random() < 0.2 else (low or 0) + width
        spans.append((rng.choice("abce"), low, high, i))
    points += [(None, 5, 900), ("a", 5, 901), ("a", 5, 902)]
    want = sorted(
        (p[2], s[3]) for p in points for s in spans
        if p[0] == s[0] and (s[1] is None or s[1] <= p[1]) and (s[2] is None or p[1] < s[2])
    )
    found = interval_join(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), ["k"], "p", "a", "b", few)
    assert sorted(map(tuple, found.select("name", "own").collect())) == want
    assert sorted(found.columns) == ["a", "b", "k", "name", "own", "p"]


def test_tried_pairs_grow_with_found_ones(spark):
    """Keys with 20 000 intervals side by side: a point tries a few, not all."""
    key = (F.col("id") % 2).alias("k")
    spans = spark.range(40_000).select(key, F.floor(F.col("id") / 2).alias("n")).select("k", (F.col("n") * 7).alias("a"), (F.col("n") * 7 + 7).alias("b"))
    points = spark.range(140_000).select(key, F.col("id").alias("p"))
    found = interval_join(points, spans, ["k"], "p", "a", "b")
    assert found.count() == 140_000
    tree = found._jdf.queryExecution().analyzed().toString()
    assert "_level" in tree and "_bin" in tree
    tried = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in tried and "Cartesian" not in tried


def members_of_many(spark, n):
    """One source that moves from family to family every ten positions, another that stays."""
    steps = spark.range(1, n + 1).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("family_id"), F.lit(1).alias("version_seq"), F.lit("MERGED").alias("state"),
        (F.col("id") * 10).alias("v_from"), F.when(F.col("id") < n, F.col("id") * 10 + 10).alias("v_to"),
        F.lit("s").alias("system_uuid"), F.lit("t").alias("sensor_id"), F.col("id").cast("int").alias("source_step"),
    )
    stays = spark.range(1).select(
        F.lit("own").alias("family_id"), F.lit(1).alias("version_seq"), F.lit("NONE").alias("state"), F.lit(5).cast("bigint").alias("v_from"),
        F.lit(None).cast("bigint").alias("v_to"), F.lit("o").alias("system_uuid"), F.lit("u").alias("sensor_id"), F.lit(1).alias("source_step"),
    )
    return steps.unionByName(stays).select(
        "*", F.lit(1).alias("n_sons"), F.lit(0).alias("son_ordinal"), F.lit("x").alias("reports_id"),
        F.lit(0).cast("bigint").alias("data_offset"), F.lit(0).alias("same_source_ordinal"), F.col("system_uuid").alias("same_source_uuid"),
    )


def test_source_with_10_000_versions(spark):
    n = 10_000
    members = members_of_many(spark, n)
    reports = [("t", i, 10 * i + 3, "t", "x") for i in range(0, n + 50, 50)] + [("u", i, i, "u", "x") for i in range(0, 40, 3)]
    frame = reports_frame(spark, reports)
    got = {(r.topic, r.pos): r.family_id for r in routing.route(frame, members, "resume").collect()}
    assert got == {
        **{("t", p): f"f{min(p // 10, n)}" for t, _, p, *_ in reports if t == "t" and p >= 10},
        **{("u", p): "own" for t, _, p, *_ in reports if t == "u" and p >= 5},
    }
    # the last reports are heard by few versions, the first by all
    late = reports_frame(spark, [r for r in reports if r[2] > 10 * n - 5_000] + reports[:1])
    counts = {r.pos: r["count"] for r in routing.route(late, members, "replay").filter("topic = 't'").groupBy("pos").count().collect()}
    assert counts == {p: n - min(max(p // 10, 1), n) + 1 for t, _, p, *_ in reports if t == "t" and (p > 10 * n - 5_000 or p == 3)}


@pytest.mark.parametrize("mode,seeds", [("replay", "own"), ("resume", "carry")])
@pytest.mark.parametrize("few", [0, 2])
def test_all_bins_give_the_same_rows(spark, mode, seeds, few):
    events, reports = random_control(8, n_events=60, n_topics=2, n_ids=1), random_reports(8, n_topics=2, n_ids=1)
    life = lifecycle(control_frame(spark, events))
    routed = routing.route(reports_frame(spark, reports), life.members, mode, few)
    wanted, dead = records(Registry(events), reports, mode, seeds)
    assert sorted((r.family_id, r.version_seq, r.pos, r.topic, r.offset, r.sub_ordinal, r.reporter_uuid) for r in routing.accepted(routed).collect()) == [
        r[:7] for r in wanted
    ]
    assert dead_rows(routing.rejected(routed)) == dead


@pytest.mark.parametrize("mode", ["replay", "resume"])
def test_one_scan_and_no_range_join(spark, sf, mode):
    events = table(spark, sf, "events")
    life = lifecycle(b1_control(events))
    plan = Fusion(life, b1_reports(events, True), mode).accepted._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("events.parquet") == 1
    for banned in ("NestedLoop", "Cartesian", "Python"):
        assert banned not in plan

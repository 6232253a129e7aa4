"""The registered queries against their SQL, the binding counts, and what the plans may contain."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from kinweave.operators import families, routing
from kinweave.operators.lifecycle import lifecycle
from kinweave.plans.fusion import Fusion
from kinweave.sources.bindings import b1_bad_topics, b1_control, b1_reports, table

SLOW = {"stream_updates"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return connection


def plain(value):
    return repr(value) if isinstance(value, float) else None if value is None else str(value)


CHECKED = [
    "control_union", "control_validated", "family_versions", "rejected_events", "membership_asof",
    "reports_from_offset", "reports_filtered", "attributes_converted", "reports_routed_foreign_replay",
    "family_seeds_carry", "family_updates_replay", "family_snapshot", "published_updates", "stream_latest",
    "throttled_stream", "stop_by_name", "merged_ranges", "mapped_branches", "tee_suffix", "upper_case", "twin_primes",
    "variant_collect", "take_while", "ordered_fold", "ordered_fold_pieces", "stream_take_while", "stream_killed_by_key", "tokenize", "log_levels", "file_lines",
    "stream_late_updates", "rejected_events_all", "source_registry", "reports_filtered", "text_written", "lines_by_level", "observed_events",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    got = contract.queries()[name](spark, sf)
    want = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in want.description]
    columns = sorted(got.columns)
    assert columns == sorted(names)
    places = [names.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    right = sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=str)
    assert left == right


def test_every_query_has_sql():
    assert set(contract._own_queries()) <= set(contract.oracle_sql())


@pytest.fixture(scope="module")
def b1(spark, sf):
    events = table(spark, sf, "events")
    return events, lifecycle(b1_control(events))


def test_binding_counts(b1):
    events, life = b1
    members = life.members
    assert members.count() == 115
    assert members.select("family_id", "version_seq").distinct().count() == 95
    assert members.filter("v_to is null").select("family_id").distinct().count() == 67
    for foreign, mode, routed, accepted in (
        (False, "resume", 1000, 1000), (False, "replay", 1312, 1312), (True, "resume", 999, 993), (True, "replay", 1311, 1304),
    ):
        rows = routing.route(b1_reports(events, foreign), members, mode)
        assert (rows.count(), routing.accepted(rows).count()) == (routed, accepted)


def test_refused_events_change_nothing(spark, b1):
    events, life = b1
    other = lifecycle(b1_control(events, b1_bad_topics(events)))
    assert sorted(other.members.collect()) == sorted(life.members.collect())


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_record_plan(b1):
    """Equi joins only, no Python, and one exchange of the reports before the sons are filled."""
    events, life = b1
    out = Fusion(life, b1_reports(events), "replay")
    plan = plan_of(out.records).split("== Physical Plan ==")[1]
    for banned in ("NestedLoop", "Cartesian", "Python", "Pandas", "ArrowEval"):
        assert banned not in plan
    above = plan.split("Window [last(")[0]
    assert "Exchange hashpartitioning" not in above
    between = plan.split("Window [last(")[1].split("Window [row_number(")[0]
    assert "Exchange hashpartitioning" not in between


def test_reports_are_scanned_for_one_join_only(b1):
    """Records, seeds and dead letters start from the written join, also where topics are columns of their own."""
    events, life = b1
    out = Fusion(life, b1_reports(events, True), "replay")
    for frame in (out.records, out.rejected_reports, out.snapshot):
        assert "events.parquet" not in plan_of(frame).split("== Physical Plan ==")[1]


def test_pruned_scan(b1):
    events, life = b1
    routed = routing.route(b1_reports(events), life.members, "resume").select("family_id", "pos")
    plan = plan_of(routed)
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "events.parquet" in line]
    assert scans and all("props" not in line.split("ReadSchema")[1] for line in scans)


def test_snapshot_needs_no_record_log(b1):
    events, life = b1
    out = Fusion(life, b1_reports(events), "replay")
    assert "Window" not in plan_of(families.family_snapshot(out.routed, life.members, out.seeds))
    assert out.snapshot.filter(F.col("live")).select("entityID").distinct().count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 1000


def test_workers_get_the_package(tmp_path, sf):
    """Run from a folder that does not hold the package, which only the driver has on its path."""
    home = os.path.dirname(os.path.abspath(contract.__file__))
    code = f"""
import sys
sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
import __spark_entry__ as contract
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {str(tmp_path / 'kept')!r}).getOrCreate())
print("rows", contract.queries()["family_versions"](spark, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows 115" in done.stdout, done.stderr[-2000:]

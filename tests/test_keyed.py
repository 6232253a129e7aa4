"""Keyed state in a stream against a plain loop over the arrivals."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.sinks.files import batch_table
from kinweave.streaming import keyed
from kinweave.streaming.keyed import switched_by_key, take_while_stream

SCHEMA = "k string, pos bigint, big bigint, kind string"


def batches(seed, n=90):
    """Three batches; the last comes partly late. One key has most of the rows, one key is null."""
    rng = random.Random(seed)
    rows = [
        (rng.choice(["hot", "hot", "hot", "a", "b", None]), pos, rng.choice([None, 2**62 + pos]),
         rng.choice(["row", "row", "row", "row", "kill", "start", None]))
        for pos in range(n)
    ]
    late = [r for r in rows if r[1] % 10 == 4]
    rest = [r for r in rows if r[1] % 10 != 4]
    return [rest[:30], rest[30:60], rest[60:] + late]


def arrive(spark, folder, parts, step):
    """One query per part over the same checkpoint: each starts again where the last one ended."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        batch_table(step(stream), f"{folder}/out", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return sorted((tuple(r[c] for c in ("k", "pos", "big", "kind")) for r in out.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("salts", [1, 5])
def test_take_while_over_batches(spark, tmp_path, salts):
    parts, want, ended = batches(1), [], set()
    for rows in parts:
        for row in sorted(rows, key=lambda r: r[1]):
            if row[0] not in ended:
                want.append(row)
                if row[3] in (None, "kill"):
                    ended.add(row[0])
    got = arrive(spark, tmp_path, parts, lambda s: take_while_stream(s, ["k"], ["pos"], F.col("kind") != "kill", salts))
    assert got == sorted(want, key=lambda r: r[1])
    assert 0 < len(want) < 90


def test_keys_are_killed_and_started(spark, tmp_path):
    parts, want, dead = batches(2), [], set()
    for rows in parts:
        for row in sorted(rows, key=lambda r: r[1]):
            if row[3] == "kill":
                dead.add(row[0])
            elif row[3] == "start":
                dead.discard(row[0])
            elif row[0] not in dead:
                want.append(row)
    action = F.when(F.col("kind") == "kill", False).when(F.col("kind") == "start", True)
    got = arrive(spark, tmp_path, parts, lambda s: switched_by_key(s, ["k"], ["pos"], action, 4))
    assert got == sorted(want, key=lambda r: r[1])
    assert 0 < len(want) < 60


def test_columns_of_all_kinds_pass_unchanged(spark, tmp_path):
    rows = spark.range(6).select(
        (F.col("id") % 2).alias("k"), F.col("id").alias("pos"), F.expr("timestamp_micros(id * 1000001)").alias("at"),
        F.expr("cast(id / 3 as decimal(20, 6))").alias("amount"), F.array(F.col("id"), F.lit(None)).alias("list"),
        F.struct(F.lit(None).cast("bigint").alias("none"), F.col("id").cast("string").alias("name")).alias("nested"),
        F.when(F.col("id") != 3, F.col("id") / 7).alias("share"), F.expr("cast('x' as binary)").alias("raw"),
    )
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = take_while_stream(stream, ["k"], ["at", "pos"], F.lit(True), 3)
    batch_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(*rows.columns).orderBy("pos").collect()
    assert got == rows.orderBy("pos").collect()


def test_empty_batch(spark, tmp_path):
    assert arrive(spark, tmp_path, [[], [("a", 1, None, "row")]], lambda s: take_while_stream(s, ["k"], ["pos"], F.lit(True))) == [
        ("a", 1, None, "row")
    ]


@pytest.mark.parametrize("final", [True, False])
def test_a_batch_in_chunks_reads_one_row_per_key(spark, tmp_path, monkeypatch, final):
    """Chunks of a few rows, gates written anew every other batch, and one row per key and batch as state."""
    monkeypatch.setattr(keyed, "COMPACT_EVERY", 2)
    monkeypatch.setattr(keyed.ordered, "ROWS_PER_CHUNK", 20)
    rng = random.Random(7)
    kinds = ["row"] * (9 if final else 3) + ["kill", "start"]
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), pos, None, rng.choice(kinds)) for pos in range(200)]
    parts, want, dead = [rows[i: i + 40] for i in range(0, 200, 40)], [], set()
    for key, *rest in rows:
        if rest[2] == "kill":
            if final and key not in dead:
                want.append((key, *rest))
            dead.add(key)
        elif rest[2] == "start" and not final:
            dead.discard(key)
        elif key not in dead:
            want.append((key, *rest))
    action = F.when(F.col("kind") == "kill", False).when(F.col("kind") == "start", True)
    step = (lambda s: take_while_stream(s, ["k"], ["pos"], F.col("kind") != "kill")) if final else (
        lambda s: switched_by_key(s, ["k"], ["pos"], action, 4)
    )
    assert arrive(spark, tmp_path, parts, step) == want
    gates = spark.read.parquet(f"{tmp_path}/checkpoint/gates")
    assert gates.count() == gates.select("_key", "batch").distinct().count() > 0
    assert gates.agg(F.min("batch")).first()[0] == 2


def test_a_take_while_moves_no_rows_through_python(spark):
    rows = spark.createDataFrame([("a", 1, None, "row"), ("a", 2, None, "kill"), ("a", 3, None, "row")], SCHEMA)
    gated = take_while_stream(rows, ["k"], ["pos"], F.col("kind") != "kill")
    marked = rows.select(
        F.struct("k").alias("_key"), F.struct("pos").alias("_at"), gated.mark.alias("_mark"), gated.passes.alias("_passes"), F.struct("*").alias("_row")
    )
    kept, ends = gated._taken(marked, ends_before := marked.select("_key", F.lit(True).alias("open")).limit(0))
    assert ends_before.isEmpty() and [r._row.pos for r in kept.orderBy("_at").collect()] == [1, 2]
    assert [r.open for r in ends.collect()] == [False]
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()

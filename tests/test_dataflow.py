"""Functions, ordered operators, sources and sinks of the dataflow side."""

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from kinweave.functions.ids import is_canonical_id, uuid_of
from kinweave.functions.numbers import is_prime
from kinweave.functions.text import framed_lines, log_level, tokens
from kinweave.operators import flows, routing
from kinweave.operators.attributes import converted, invalid_enum
from kinweave.operators.ordered import ordered_concat, ordered_pieces, ordinal, position_cuts, previous_known, take_while_inclusive
from kinweave.schemas import DETECTION_EVENT, GENERAL_ATTRIBUTES, MERGE_EVENT
from kinweave.sinks.files import batch_table, write_by_level, write_text
from kinweave.sinks.topics import kafka_sink_options, update_messages
from kinweave.sources import files, generators, topics

from .logs import reports_frame
from .model import uuid_of as model_uuid

RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def applied(spark, values, kind, expression):
    rows = column(spark, values, kind).select("i", expression.alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_uuid(spark):
    got = applied(spark, ["a", "b"], "string", uuid_of(F.lit("creation"), F.col("v"), F.lit("7")))
    assert got == [model_uuid("creation", x, "7") for x in "ab"]
    checks = applied(spark, [got[0], got[0].upper(), "x", None], "string", is_canonical_id(F.col("v")))
    assert checks == [True, False, False, False]


def brute_prime(n):
    return n > 1 and all(n % i for i in range(2, int(n ** 0.5) + 1))


def test_primes(spark):
    rows = spark.range(-5, 5000).select("id", is_prime(F.col("id")).alias("p")).collect()
    assert all(r.p == brute_prime(r.id) for r in rows)
    # strong pseudoprimes to small bases, squares near the limit of the fast path, large primes
    large = {3215031751: False, 3037000499: False, 3037000507: True, 2**31 - 1: True, 2**61 - 1: True,
             9223372036854775783: True, 3825123056546413051: False, 4759123141: False, 1122004669633: False}
    assert applied(spark, list(large), "long", is_prime(F.col("v"))) == list(large.values())


def test_twin_primes_at_the_end_of_the_range(spark):
    from kinweave.functions.numbers import is_twin_prime

    ends = [2**63 - 1, 2**63 - 2, 2**63 - 3, 2**63 - 25, -(2**63)]
    assert applied(spark, ends, "long", is_twin_prime(F.col("v"))) == [False] * 5
    assert applied(spark, ends, "long", is_prime(F.col("v"))) == [False, False, False, True, False]


def test_take_while_stops_at_null(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("a", 3, True)], "k string, n int, p boolean")
    got = take_while_inclusive(rows, ["k"], ["n"], F.col("p")).select("n").collect()
    assert sorted(r.n for r in got) == [1, 2]


def test_avro_schema_of_reports_has_the_wire_types():
    from kinweave.schemas import ENTITY_FAMILY

    fields = {f["name"]: f["type"] for f in json.loads(topics.avro_schema(GENERAL_ATTRIBUTES))["fields"]}
    assert fields["nationality"]["type"] == "enum" and fields["nationality"]["symbols"] == ["ISRAEL", "USA", "SPAIN"]
    assert fields["category"]["symbols"] == ["airplane", "boat"]
    sons = {f["name"]: f["type"] for f in json.loads(topics.avro_schema(ENTITY_FAMILY))["fields"]}["sons"]
    assert len(sons) == 1 and sons[0]["type"] == "array"


def test_topic_rows_become_one_log(spark):
    report = {"basicAttributes": {"sourceName": "t0", "entityOffset": 3}, "externalSystemID": "x0", "speed": 2.5}
    rows = spark.createDataFrame([
        ("creation", 0, 1.0, json.dumps({"sourceName": "t0", "externalSystemID": "x0", "dataOffset": 0})),
        ("merge", 5, 2.0, json.dumps({"mergedEntitiesId": ["a"]})), ("t0", 9, 3.0, json.dumps(report)),
    ], "topic string, offset bigint, s double, value string").select(
        "topic", "offset", F.timestamp_seconds("s").alias("timestamp"), F.col("value").cast("binary").alias("value"),
        F.lit(None).cast("binary").alias("key"),
    )
    got = {r.topic: r for r in topics.fusion_rows(rows).collect()}
    assert [got[t].kind for t in ("creation", "merge", "t0")] == ["CREATE", "MERGE", "REPORT"]
    assert [got[t].pos for t in ("creation", "merge", "t0")] == [1_000_000, 2_000_000, 3_000_000]
    assert got["creation"].sourceName == "t0" and got["t0"].report.speed == 2.5 and got["t0"].offset == 9
    assert topics.as_text(rows).filter("topic = 'merge'").first().value == '{"mergedEntitiesId": ["a"]}'
    many = topics.kafka_options("b", ["t0"], {"t0": 4}, partitions=3)
    assert json.loads(many["assign"]) == {"t0": [0, 1, 2]} and json.loads(many["startingOffsets"]) == {"t0": {"0": 4, "1": 4, "2": 4}}


def test_twin_primes(spark):
    got = sorted(r.value for r in flows.twin_primes(spark.range(1000).union(spark.range(50)), "id").collect())
    assert got == [n for n in range(1000) if brute_prime(n) and brute_prime(n + 2)]


def model_tokens(text):
    parts, current = [], ""
    for c in text:
        if c in " \t\n\x0b\f\r":
            parts.append(current)
            current = ""
        else:
            current += c
    parts.append(current)
    if len(parts) == 1:
        return parts
    while parts and parts[-1] == "":
        parts.pop()
    return parts


@RELAXED
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b", max_size=12), min_size=1, max_size=20))
def test_tokens(spark, texts):
    assert applied(spark, texts, "string", tokens(F.col("v"))) == [model_tokens(t) for t in texts]


def test_tokens_of_edges(spark):
    assert applied(spark, ["", " ", "a  b ", " a", "A B C"], "string", tokens(F.col("v"))) == [
        [""], [], ["a", "", "b"], ["", "a"], ["A", "B", "C"]]


def test_lines_and_levels(spark):
    texts = ["a\nb\n", "a\r\n\nb", "", "\n", "x"]
    assert applied(spark, texts, "string", framed_lines(F.col("v"))) == [["a", "b"], ["a\r", "", "b"], [], [""], ["x"]]
    lines = ["[INFO] a [ERROR] b", "none", "[info]", "[TRACE] x [DEBUG]", "[WARN]", ""]
    assert applied(spark, lines, "string", log_level(F.col("v"))) == ["ERROR", "UNKNOWN", "UNKNOWN", "DEBUG", "WARN", "UNKNOWN"]


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows under one key; every fifth has a value."""
    rows = [(("hot" if i % 3 else f"k{i % 7}"), i, i % 4, str(i) if i % 5 == 0 else None) for i in range(400)]
    return spark.createDataFrame(rows, "k string, pos int, sub int, v string"), rows


@pytest.mark.parametrize("limit", [1000, 50, 7])
def test_ordered_operators_over_chunks(spark, skewed, limit):
    df, rows = skewed
    cuts = position_cuts(df, "pos", limit)
    assert bool(cuts) == (limit < 400)
    got = {r.pos: r for r in previous_known(df, ["k"], ["pos", "sub"], "v", "prev", cuts).collect()}
    ranks = {r.pos: r.n for r in ordinal(df, ["k"], ["pos", "sub"], "n", cuts).collect()}
    last, count = {}, {}
    for k, pos, _, v in rows:
        assert got[pos].prev == last.get(k)
        last[k] = v or last.get(k)
        count[k] = count.get(k, 0) + 1
        assert ranks[pos] == count[k]
    folded = {r.k: r.f for r in ordered_concat(
        df.withColumn("c", F.col("pos").cast("string")), ["k"], ["pos", "sub"], "c", "f", cuts, separator=",").collect()}
    assert folded == {k: ",".join(str(p) for kk, p, _, _ in rows if kk == k) for k in {r[0] for r in rows}}


@pytest.mark.parametrize("limit,size", [(1000, 4096), (50, 16), (7, 1)])
def test_fold_in_pieces(spark, skewed, monkeypatch, limit, size):
    """Pieces of a key laid at their starts are its whole fold; no piece holds more than ``size`` rows."""
    df, rows = skewed
    monkeypatch.setattr("kinweave.operators.ordered.PIECES_PER_BLOCK", 3)
    df = df.withColumn("c", F.col("pos").cast("string")).withColumn("k", F.when(F.col("k") != "k3", F.col("k")))
    df = df.withColumn("c", F.when(F.col("pos") % 9 != 1, F.col("c")))
    pieces = ordered_pieces(df, ["k"], ["pos", "sub"], "c", position_cuts(df, "pos", limit), separator=", ", rows_per_piece=size)
    folds = {}
    for r in sorted(pieces.collect(), key=lambda r: (str(r.k), r.piece)):
        assert r.start == len(folds.get(r.k, "")) and r.text.count(", ") <= size
        folds[r.k] = folds.get(r.k, "") + r.text
    want = {}
    for k, p, *_ in rows:
        if p % 9 != 1:
            want.setdefault(None if k == "k3" else k, []).append(str(p))
    assert folds == {k: ", ".join(v) for k, v in want.items()}


def test_take_while(spark, skewed):
    df, rows = skewed
    got = sorted(r.pos for r in take_while_inclusive(df, ["k"], ["pos"], F.col("pos") % 11 != 10).collect())
    want, over = [], set()
    for k, pos, *_ in rows:
        if k not in over:
            want.append(pos)
            if pos % 11 == 10:
                over.add(k)
    assert got == sorted(want)


def test_generators(spark):
    ranges = [generators.inclusive_range(spark, a, b) for a, b in generators.SAMPLE_RANGES]
    assert sorted(r.value for r in ranges[0].union(ranges[1]).collect()) == list(range(100, 300))
    ints = generators.collection(spark, generators.SAMPLE_INTS, "int")
    both = flows.branches(ints, a=lambda d: d.withColumn("value", F.col("value") + 1), b=lambda d: d)
    assert both.groupBy("branch").agg(F.sum("value").alias("s")).count() == 2
    values = generators.random_ints(spark, 2000, 10).groupBy("value").count().collect()
    assert {r.value for r in values} == set(range(10))


def test_variant_and_observed_count(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "tag string, v int")
    kept, seen = flows.counted(flows.collect_variant(rows, F.col("tag"), "a", F.col("v")), "kept")
    assert sorted(r.payload for r in kept.collect()) == [1, 3] and seen.get["rows"] == 2


def test_fan_out_writes_both(spark, tmp_path):
    df = spark.range(10)
    flows.fan_out(df, lambda d: d.write.parquet(str(tmp_path / "a")), lambda d: d.write.json(str(tmp_path / "b")))
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.json(str(tmp_path / "b")).count() == 10


def test_text_files(spark, tmp_path):
    assert write_text(column(spark, [3, 5, 11], "int"), "v", str(tmp_path / "primes")) == 4
    source = tmp_path / "log.txt"
    source.write_bytes(b"[INFO] one\n[WARN] two\r\n" + b"x" * 513 + b"\nlast [ERROR]")
    fits, too_long = files.split_by_length(files.read_lines(spark, str(source)))
    assert sorted(r.line for r in fits.collect()) == ["[INFO] one", "[WARN] two\r", "last [ERROR]"]
    assert too_long.count() == 1
    write_by_level(fits, str(tmp_path / "levels"))
    assert sorted(d for d in os.listdir(tmp_path / "levels") if d.startswith("level=")) == ["level=ERROR", "level=INFO", "level=WARN"]


def test_batch_table_restart_does_not_repeat(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        batch_table(rows, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_kafka_options():
    options = topics.kafka_options("b:9092", ["creation", "merge"], {"merge": 7}, 100)
    assert json.loads(options["assign"]) == {"creation": [0], "merge": [0]}
    assert json.loads(options["startingOffsets"]) == {"creation": {"0": -2}, "merge": {"0": 7}}
    assert options["kafka.group.id"] == "group1" and options["maxOffsetsPerTrigger"] == "100"
    assert topics.kafka_options("b:9092", ["update"])["startingOffsets"] == "earliest"
    assert json.loads(topics.descriptor_options("b:9092", "s1", 5)["startingOffsets"]) == {"s1": {"0": 5}}
    assert kafka_sink_options("b:9092") == {"kafka.bootstrap.servers": "b:9092"}


def test_decode_topics(spark):
    rows = spark.createDataFrame([
        ("creation", 0, bytearray(b'{"sourceName":"s","externalSystemID":"x","dataOffset":3}')),
        ("merge", 4, bytearray(b'{"mergedEntitiesId":["a","b"]}')),
        ("split", 9, bytearray(b'{"splittedEntityID":"a"}')),
    ], "topic string, offset long, value binary")
    log = {r.kind: r for r in topics.control_from_topics(rows, F.col("offset") + 1).collect()}
    assert (log["CREATE"].sourceName, log["CREATE"].dataOffset, log["CREATE"].pos) == ("s", 3, 1)
    assert log["MERGE"].mergedEntitiesId == ["a", "b"] and log["MERGE"].sourceName is None
    assert log["SPLIT"].splittedEntityID == "a" and log["SPLIT"].topic == "split"
    with pytest.raises(ValueError):
        topics.decode(F.col("value"), MERGE_EVENT, "xml")
    schema = json.loads(topics.avro_schema(DETECTION_EVENT, "detectionEvent"))
    assert [f["type"] for f in schema["fields"]] == ["string", "string", "long"]
    assert json.loads(topics.avro_schema(MERGE_EVENT))["fields"][0]["type"] == {"type": "array", "items": "string"}


def test_each_row_is_decoded_or_a_dead_letter(spark):
    good = {"basicAttributes": {"sourceName": "t0"}, "externalSystemID": "x", "speed": 1.5, "category": "boat"}
    rows = [
        ("creation", 0, "{broken"), ("creation", 1, '{"sourceName": "t0"}'), ("creation", 2, ""), ("merge", 3, "{}"),
        ("merge", 4, '{"mergedEntitiesId": "a"}'), ("merge", 5, '{"mergedEntitiesId": []}'), ("split", 6, None),
        ("split", 7, '{"splittedEntityID": "a"}'), ("t0", 8, json.dumps(good)), ("t0", 9, json.dumps(good)[:-1]),
        ("t0", 10, json.dumps(good | {"speed": "fast"})), ("t0", 11, json.dumps(good | {"category": "tank", "nationality": "X"})),
        ("t0", 12, json.dumps({"speed": 2.0})), ("t0", 13, "[]"), ("t0", 14, json.dumps(good | {"more": 1})),
    ]
    frame = spark.createDataFrame(rows, "topic string, offset bigint, text string").select(
        "topic", "offset", F.col("text").cast("binary").alias("value")
    )
    dead = {r.offset: (r.reason, r.fields) for r in topics.rejected_records(frame, F.col("offset")).collect()}
    assert dead == {
        0: ("MALFORMED", None), 1: ("MISSING_FIELD", ["externalSystemID", "dataOffset"]), 2: ("MALFORMED", None),
        3: ("MISSING_FIELD", ["mergedEntitiesId"]), 4: ("MALFORMED", None), 6: ("NULL_VALUE", None), 9: ("MALFORMED", None),
        10: ("MALFORMED", None), 11: ("INVALID_ENUM", ["nationality", "category"]),
        12: ("MISSING_FIELD", ["basicAttributes.sourceName", "externalSystemID"]), 13: dead[13],
    }
    assert dead[13][0] in ("MALFORMED", "MISSING_FIELD")
    kept = topics.fusion_rows(frame, F.col("offset")).collect()
    assert sorted(r.offset for r in kept) == [5, 7, 8, 14]
    assert {r.offset: r.kind for r in kept} == {5: "MERGE", 7: "SPLIT", 8: "REPORT", 14: "REPORT"}


def test_report_round_trip_and_conversion(spark):
    reports = reports_frame(spark, [("s1", 4, 9, "s1", "x"), ("s2", 5, 10, "s2", "y")])
    raw = reports.select("topic", "offset", F.to_json("report").cast("binary").alias("value"))
    back = topics.reports_from_topics(raw, F.col("offset") + 5)
    assert sorted(back.collect()) == sorted(reports.select(*back.columns).collect())
    out = back.select(converted(F.col("report")).alias("a"), invalid_enum(F.col("report")).alias("bad"))
    assert [f.name for f in out.schema["a"].dataType.fields] == [f.name for f in GENERAL_ATTRIBUTES.fields]
    assert not out.filter("bad").count()
    wrong = back.withColumn("report", F.col("report").withField("category", F.lit("tank")))
    assert wrong.filter(invalid_enum(F.col("report"))).count() == 2


def test_scan_from_offset_and_by_descriptor(spark):
    reports = reports_frame(spark, [("s1", o, o, "s1", "x" if o % 2 else "y") for o in range(10)] + [("s2", 3, 3, "s2", "x")])
    assert routing.read_from(reports, "s1", data_offset=4).count() == 6
    assert [r.offset for r in routing.read_from(reports, "s1", "x", 4).orderBy("offset").collect()] == [5, 7, 9]
    starts = spark.createDataFrame([("s1", 8), ("s2", 3)], "topic string, data_offset long")
    assert routing.read_from_offsets(reports, starts).count() == 3


def test_update_messages(spark):
    record = spark.createDataFrame([("f", "NONE")], "entityID string, stateChanges string").select(
        "*", F.lit(None).cast(GENERAL_ATTRIBUTES).alias("entityAttributes"),
        F.array(F.struct(F.lit("s").alias("entityID"), F.lit(None).cast(GENERAL_ATTRIBUTES).alias("entityAttributes"))).alias("sons"),
    )
    row = update_messages(record).first()
    assert (row.topic, row.key) == ("update", "f")
    assert json.loads(row.value) == {"entityID": "f", "stateChanges": "NONE", "entityAttributes": None,
                                     "sons": [{"entityID": "s", "entityAttributes": None}]}

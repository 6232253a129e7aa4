"""Topic sources: Kafka options, typed decoding, and parquet topics with the same columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.control import control_union, fan_in
from ..schemas import (
    CATEGORIES, CREATION_TOPIC, GENERAL_ATTRIBUTES, MERGE_TOPIC, NATIONALITIES, PAYLOAD_OF_TOPIC, SPLIT_TOPIC,
)

# The consumer group, and the only partition that is read.
GROUP_ID = "group1"
PARTITION = 0


def kafka_options(
    servers: str,
    topics: list[str],
    starting_offsets: dict[str, int] | None = None,
    max_offsets_per_trigger: int | None = None,
    partitions: int = 1,
) -> dict[str, str]:
    """Options of one shared scan over all topics (S1, S2, S5): partition 0, earliest by default.

    ``starting_offsets`` gives the first offset (inclusive) per topic; -2 stands for earliest.
    ``partitions``: how many partitions each topic has, all of which are read.
    """
    numbers = range(PARTITION, PARTITION + partitions)
    options = {
        "kafka.bootstrap.servers": servers,
        "assign": json.dumps({topic: list(numbers) for topic in topics}),
        "startingOffsets": "earliest",
        "kafka.group.id": GROUP_ID,
    }
    if starting_offsets:
        options["startingOffsets"] = json.dumps(
            {topic: {str(n): starting_offsets.get(topic, -2) for n in numbers} for topic in topics}
        )
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def descriptor_options(servers: str, sensor_id: str, data_offset: int) -> dict[str, str]:
    """Options of the scan of one source descriptor (S4); its filter is ``routing.read_from``."""
    return kafka_options(servers, [sensor_id], {sensor_id: data_offset})


def read_kafka(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """The raw topic rows; needs the Kafka connector package on the cluster."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").options(**options).load()


def as_text(rows: DataFrame) -> DataFrame:
    """Key and value of a string topic."""
    return rows.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "topic", "offset",
    )


def decode(value: Column, schema: T.StructType, encoding: str = "json") -> Column:
    """Value bytes to a record (S6). ``avro`` skips the five bytes that carry the schema id."""
    if encoding == "json":
        return F.from_json(value.cast("string"), schema)
    if encoding == "avro":
        from pyspark.sql.avro.functions import from_avro

        return from_avro(F.expr("substring(value, 6)"), avro_schema(schema))
    raise ValueError("encoding is 'json' or 'avro'")


_AVRO_NAMES = {
    T.StringType: "string", T.LongType: "long", T.IntegerType: "int", T.DoubleType: "double",
    T.BooleanType: "boolean",
}


# Fields that are enums on the wire, with their symbols, and the field that is a union of one branch.
_AVRO_ENUMS = {"nationality": NATIONALITIES, "category": CATEGORIES}
_AVRO_UNIONS = ("sons",)


def avro_schema(schema: T.StructType, name: str = "record") -> str:
    """Avro schema text of a fixed record type, as its writer has it: enums by index, unions by branch."""

    def field(f: T.StructField, path: str):
        if f.name in _AVRO_ENUMS:
            return {"type": "enum", "name": path, "symbols": list(_AVRO_ENUMS[f.name])}
        return [of(f.dataType, path)] if f.name in _AVRO_UNIONS else of(f.dataType, path)

    def of(kind: T.DataType, path: str):
        if isinstance(kind, T.StructType):
            return {"type": "record", "name": path,
                    "fields": [{"name": f.name, "type": field(f, f"{path}_{f.name}")} for f in kind.fields]}
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType, path + "_item")}
        return _AVRO_NAMES[type(kind)]

    return json.dumps(of(schema, name))


# The fields without which a record says nothing; the published schemas have no optional ones.
REQUIRED = {
    CREATION_TOPIC: ("sourceName", "externalSystemID", "dataOffset"),
    MERGE_TOPIC: ("mergedEntitiesId",),
    SPLIT_TOPIC: ("splittedEntityID",),
}
REPORT_REQUIRED = ("basicAttributes.sourceName", "externalSystemID")
_CORRUPT = "_corrupt"


def _opened(rows: DataFrame, topic: str | None, encoding: str) -> DataFrame:
    """Rows with ``_record``, and ``reason`` and ``fields`` where the value is no record of its topic; None: reports."""
    schema = GENERAL_ATTRIBUTES if topic is None else PAYLOAD_OF_TOPIC[topic]
    if encoding == "json":
        wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
        record = F.from_json(F.col("value").cast("string"), wide, {"columnNameOfCorruptRecord": _CORRUPT})
        broken = F.col("_record").isNull() | F.col(f"_record.{_CORRUPT}").isNotNull()
    else:
        record, broken = decode(F.col("value"), schema, encoding), F.col("_record").isNull()

    def named(bad: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in bad.items()]))

    names = REPORT_REQUIRED if topic is None else REQUIRED[topic]
    missing = named({name: F.col(f"_record.{name}").isNull() for name in names})
    outside = named({
        name: F.coalesce(~F.col(f"_record.{name}").isin(*symbols), F.lit(False)) for name, symbols in _AVRO_ENUMS.items()
    }) if topic is None else F.array().cast("array<string>")
    return (
        rows.withColumn("_record", record)
        .withColumn("_broken", F.col("value").isNull() | broken).withColumn("_missing", missing).withColumn("_outside", outside)
        .withColumn(
            "reason",
            F.when(F.col("value").isNull(), "NULL_VALUE").when(F.col("_broken"), "MALFORMED")
            .when(F.size("_missing") > 0, "MISSING_FIELD").when(F.size("_outside") > 0, "INVALID_ENUM"),
        )
        .withColumn("fields", F.when(F.col("reason") == "MISSING_FIELD", F.col("_missing")).when(
            F.col("reason") == "INVALID_ENUM", F.col("_outside")
        ))
    )


def control_from_topics(rows: DataFrame, position: Column, encoding: str = "json") -> DataFrame:
    """Raw rows of the three control topics to one typed log (S7); undecodable ones are in ``rejected_records``."""

    def typed(topic: str) -> DataFrame:
        opened = _opened(rows.filter(F.col("topic") == topic), topic, encoding).filter("reason is null")
        return opened.select(
            position.cast("bigint").alias("pos"), F.col("offset").cast("bigint").alias("offset"),
            F.col("offset").cast("string").alias("event_key"),
            *[F.col(f"_record.{name}").alias(name) for name in PAYLOAD_OF_TOPIC[topic].names],
        )

    return control_union(typed(CREATION_TOPIC), typed(MERGE_TOPIC), typed(SPLIT_TOPIC))


def reports_from_topics(rows: DataFrame, position: Column, encoding: str = "json") -> DataFrame:
    """Raw rows of the sensors' topics to reports; undecodable ones are in ``rejected_records``.

    A report whose nationality or category is outside its symbols is none (E6): no writer of the schema can have made
    it. An enum that is not given at all stays null.
    """
    record = F.struct(*[F.col(f"_record.{name}").alias(name) for name in GENERAL_ATTRIBUTES.names])
    return _opened(rows, None, encoding).filter("reason is null").select(
        "topic", F.col("offset").cast("bigint").alias("offset"), position.cast("bigint").alias("pos"), record.alias("report"),
    )


def rejected_records(rows: DataFrame, position: Column, encoding: str = "json") -> DataFrame:
    """Dead letters of decoding (S6): raw rows of any topic that are no record of it, with the reason.

    ``NULL_VALUE``, ``MALFORMED`` (not the encoding, or a field of another type), ``MISSING_FIELD`` and ``INVALID_ENUM``,
    checked in this order; ``fields`` names the fields of the last two. Each row is either here or decoded.
    """
    own = rows.filter(~F.col("topic").isin(*PAYLOAD_OF_TOPIC))
    parts = [_opened(rows.filter(F.col("topic") == topic), topic, encoding) for topic in PAYLOAD_OF_TOPIC]
    return fan_in(*[
        part.filter("reason is not null").select(
            "topic", F.col("offset").cast("bigint").alias("offset"), position.cast("bigint").alias("pos"), "reason", "fields", "value"
        )
        for part in [*parts, _opened(own, None, encoding)]
    ])


def arrival_position() -> Column:
    """Position of a topic row: the time the broker gave it, in microseconds. Ties fall back on topic and offset."""
    return F.unix_micros("timestamp")


def fusion_rows(rows: DataFrame, position: Column | None = None, encoding: str = "json") -> DataFrame:
    """Raw rows of control and sensor topics as one log, which the streaming engine takes.

    ``kind`` is REPORT for rows of all topics but the three control topics.
    """
    position = arrival_position() if position is None else position
    control = control_from_topics(rows, position, encoding)
    own = rows.filter(~F.col("topic").isin(*PAYLOAD_OF_TOPIC))
    return fan_in(control, reports_from_topics(own, position, encoding).withColumn("kind", F.lit("REPORT")))

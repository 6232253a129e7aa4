"""Record types of the control topics, the reports and the published families."""

from __future__ import annotations

from pyspark.sql import types as T

# Topic names, event kinds with their rank at one position, enum symbols.
CREATION_TOPIC = "creation"
MERGE_TOPIC = "merge"
SPLIT_TOPIC = "split"
UPDATE_TOPIC = "update"
KIND_RANK = {"CREATE": 0, "MERGE": 1, "SPLIT": 2, "REPORT": 3}
NATIONALITIES = ("ISRAEL", "USA", "SPAIN")
CATEGORIES = ("airplane", "boat")

DETECTION_EVENT = T.StructType([
    T.StructField("sourceName", T.StringType()),
    T.StructField("externalSystemID", T.StringType()),
    T.StructField("dataOffset", T.LongType()),
])
MERGE_EVENT = T.StructType([
    T.StructField("mergedEntitiesId", T.ArrayType(T.StringType())),
])
SPLIT_EVENT = T.StructType([
    T.StructField("splittedEntityID", T.StringType()),
])
COORDINATE = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
])
BASIC_ATTRIBUTES = T.StructType([
    T.StructField("coordinate", COORDINATE),
    T.StructField("isNotTracked", T.BooleanType()),
    T.StructField("entityOffset", T.LongType()),
    T.StructField("sourceName", T.StringType()),
])
GENERAL_ATTRIBUTES = T.StructType([
    T.StructField("basicAttributes", BASIC_ATTRIBUTES),
    T.StructField("speed", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("course", T.DoubleType()),
    T.StructField("nationality", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("pictureURL", T.StringType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("nickname", T.StringType()),
    T.StructField("externalSystemID", T.StringType()),
])
SYSTEM_ENTITY = T.StructType([
    T.StructField("entityID", T.StringType()),
    T.StructField("entityAttributes", GENERAL_ATTRIBUTES),
])
ENTITY_FAMILY = T.StructType([
    T.StructField("entityID", T.StringType()),
    T.StructField("stateChanges", T.StringType()),
    T.StructField("entityAttributes", GENERAL_ATTRIBUTES),
    T.StructField("sons", T.ArrayType(SYSTEM_ENTITY)),
])

# One row of the control log: envelope, then the payloads of all three topics side by side.
CONTROL = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("event_key", T.StringType()),
    *DETECTION_EVENT.fields,
    *MERGE_EVENT.fields,
    *SPLIT_EVENT.fields,
])
# One report: envelope and the record as it came.
REPORT = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("report", GENERAL_ATTRIBUTES),
])

PAYLOAD_OF_TOPIC = {
    CREATION_TOPIC: DETECTION_EVENT,
    MERGE_TOPIC: MERGE_EVENT,
    SPLIT_TOPIC: SPLIT_EVENT,
}

# Columns of one membership row: one son of one version of one family.
MEMBERSHIP_COLUMNS = (
    "family_id", "version_seq", "state", "v_from", "v_to", "n_sons", "son_ordinal",
    "system_uuid", "sensor_id", "reports_id", "data_offset", "same_source_ordinal",
    "same_source_uuid", "source_step", "prev_family_id", "prev_version_seq",
)

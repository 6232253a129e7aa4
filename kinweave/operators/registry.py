"""Views of the family registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .control import validate


def current(members: DataFrame) -> DataFrame:
    """Live versions with their sons."""
    return members.filter(F.col("v_to").isNull())


def as_of(members: DataFrame, position) -> DataFrame:
    """Versions live at a position; several at one position resolve to the last one opened."""
    position = F.lit(position) if isinstance(position, int) else position
    return members.filter(
        (F.col("v_from") <= position) & (F.col("v_to").isNull() | (F.col("v_to") > position))
    )


def sources(members: DataFrame) -> DataFrame:
    """Every created source once: its four identifying columns.

    A source's own CREATE version is its only row in state NONE, so no shuffle is needed.
    """
    return members.filter("state = 'NONE'").select(
        "system_uuid", "sensor_id", "reports_id", "data_offset"
    )


def created_sources(control: DataFrame) -> DataFrame:
    """The same from the control log alone: CREATE events need no other event to hold.

    Of an event key that repeats, the first event counts.
    """
    creates = validate(control).filter("reason is null and kind = 'CREATE'")
    first = creates.groupBy(F.col("event_id").alias("system_uuid")).agg(
        F.min(F.struct("pos", "topic", "offset", "sourceName", "externalSystemID", "dataOffset")).alias("_first")
    )
    return first.select(
        "system_uuid", F.col("_first.sourceName").alias("sensor_id"), F.col("_first.externalSystemID").alias("reports_id"),
        F.col("_first.dataOffset").alias("data_offset"),
    )


def explode_sons(families: DataFrame) -> DataFrame:
    """Family records to one row per son (F12): who it is and what is known of it."""
    keep = [name for name in families.columns if name not in ("sons", "entityAttributes")]
    son = F.col("_son")
    attributes = son["entityAttributes"]
    return families.select(*keep, F.posexplode("sons").alias("son_ordinal_in_family", "_son")).select(
        *keep, "son_ordinal_in_family",
        son["entityID"].alias("son_id"),
        attributes["basicAttributes"]["sourceName"].alias("son_source"),
        attributes["externalSystemID"].alias("son_external_id"),
        attributes.alias("son_attributes"),
    )

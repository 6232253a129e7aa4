"""Control plane input: typed topics, their union, and the checks that need no state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import canonical_id, is_canonical_id, uuid_of
from ..schemas import CONTROL, CREATION_TOPIC, KIND_RANK, MERGE_TOPIC, SPLIT_TOPIC

ORDER = ("pos", "kind_rank", "topic", "offset")


def kind_rank(kind: Column) -> Column:
    """Rank of the event kinds at one position."""
    rank = F.lit(None).cast("int")
    for name, value in KIND_RANK.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return rank


def fan_in(*streams: DataFrame) -> DataFrame:
    """Bag union of any number of streams by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def control_union(creation: DataFrame, merge: DataFrame, split: DataFrame) -> DataFrame:
    """The three typed control topics as one log."""
    typed = [
        rows.withColumn("kind", F.lit(kind)).withColumn("topic", F.lit(topic))
        for rows, kind, topic in (
            (creation, "CREATE", CREATION_TOPIC),
            (merge, "MERGE", MERGE_TOPIC),
            (split, "SPLIT", SPLIT_TOPIC),
        )
    ]
    united = fan_in(*typed)
    return united.select(
        *[
            F.col(f.name).cast(f.dataType) if f.name in united.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in CONTROL.fields
        ]
    )


def validate(control: DataFrame) -> DataFrame:
    """Adds event id, parsed ids and ``reason`` for events that fail whatever the state.

    The checks come in this order: malformed id, empty list, duplicate id; an unknown kind is
    refused as such.
    """
    named = (
        F.when(F.col("kind") == "MERGE", F.col("mergedEntitiesId"))
        .when(F.col("kind") == "SPLIT", F.array("splittedEntityID"))
        .otherwise(F.array().cast("array<string>"))
    )
    ids = F.transform(F.coalesce(named, F.array().cast("array<string>")), canonical_id)
    refers = F.col("kind").isin("MERGE", "SPLIT")
    reason = (
        F.when(~F.coalesce(F.col("kind").isin("CREATE", "MERGE", "SPLIT"), F.lit(False)), "UNKNOWN_KIND")
        .when(refers & ~F.forall("ids", is_canonical_id), "MALFORMED_ID")
        .when(refers & (F.size("ids") == 0), "EMPTY_LIST")
        .when(refers & (F.size(F.array_distinct("ids")) < F.size("ids")), "DUPLICATE_ID")
    )
    return (
        control.withColumn("kind_rank", kind_rank(F.col("kind")))
        .withColumn("event_id", uuid_of(F.col("topic"), F.col("event_key")))
        .withColumn("ids", ids)
        .withColumn("reason", reason)
    )

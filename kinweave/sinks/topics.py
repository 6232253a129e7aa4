"""Family records as messages of the update topic (K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import UPDATE_TOPIC


def update_messages(records: DataFrame) -> DataFrame:
    """topic, key (the family id) and value (the record as JSON) of each family record."""
    value = F.to_json(
        F.struct("entityID", "stateChanges", "entityAttributes", "sons"),
        {"ignoreNullFields": "false"},
    )
    return records.select(F.lit(UPDATE_TOPIC).alias("topic"), F.col("entityID").alias("key"), value.alias("value"))


def kafka_sink_options(servers: str) -> dict[str, str]:
    """Options of the one shared sink; needs the Kafka connector package on the cluster."""
    return {"kafka.bootstrap.servers": servers}


def publish(messages: DataFrame, servers: str) -> None:
    """Write a batch of messages to the broker."""
    messages.write.format("kafka").options(**kafka_sink_options(servers)).save()

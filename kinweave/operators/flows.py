"""Dataflow shapes on plain DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.numbers import is_twin_prime
from .control import fan_in


def branches(df: DataFrame, **flows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row to every branch, each with its own flow, labelled by branch."""
    return fan_in(*[flow(df).withColumn("branch", F.lit(name)) for name, flow in flows.items()])


def fan_out(df: DataFrame, *writers: Callable[[DataFrame], None]) -> None:
    """Write one result to several sinks, computing it once."""
    df = df.persist()
    try:
        for write in writers:
            write(df)
    finally:
        df.unpersist()


def collect_variant(df: DataFrame, tag: Column, wanted: str, payload: Column, *keep: str) -> DataFrame:
    """Payload of the rows of one variant; the others are left out."""
    return df.filter(tag == wanted).select(*keep, payload.alias("payload"))


def twin_primes(df: DataFrame, column: str) -> DataFrame:
    """Distinct values p with p and p + 2 prime (D6, D7): a filter, then a much smaller distinct."""
    return df.select(F.col(column).alias("value")).filter(is_twin_prime(F.col("value"))).distinct()


def counted(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """Pass rows on and observe metrics of them."""
    seen = Observation(name)
    return df.observe(seen, *(metrics or (F.count(F.lit(1)).alias("rows"),))), seen

"""Connected components of an id graph by large-star / small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _lowest_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("low")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_lowest_neighbour(both), "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest_neighbour(down)
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return (
        hung.union(low.select("u", F.col("low").alias("v")))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """True when every node hangs off exactly one other and that one off none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    roles = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return roles.filter("low > 1 or (low = 1 and high = 1)").isEmpty()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edge list (u, v).

    The label is the lowest id of the component. Each round ends in a written table, so the plan
    stays flat; the rounds stop when the edges are stars around the labels.
    """
    edges = materialize(_small_star(_large_star(edges.filter(F.col("u") != F.col("v")))))
    while not _all_stars(edges):
        edges = materialize(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

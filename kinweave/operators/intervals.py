"""Points in intervals (range join) as a join on equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

#: Keys with up to so many intervals have them all in one bin.
FEW = 4
#: Bins are 1, 16, 256 ... positions wide; the last level is the whole line.
_STEP, _WHOLE = 4, 63


def _level(low: Column, high: Column) -> Column:
    """The narrowest level whose bins are at least as wide as the interval; open intervals have the whole line."""
    width = high - low
    bits = F.when(width <= 1, 0).otherwise(F.length(F.bin(width - 1)))
    return F.when(width.isNull(), _WHOLE).otherwise(F.least(F.ceil(bits / _STEP) * _STEP, F.lit(_WHOLE))).cast("int")


def _bin(position: Column, level: Column) -> Column:
    return F.when(level == _WHOLE, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftright", position, level))


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str, few: int = FEW
) -> DataFrame:
    """Each point with every interval of its keys that holds it: ``low <= point < high``; null bounds are open.

    Both sides have the columns ``keys``; their other columns must differ in name. An interval lies in the one
    or two bins of its level that it touches, and a point is looked up once on each level that its keys use, so
    the pairs that are tried grow with the pairs that are found, and a key with very many intervals or points is spread
    over its bins. Keys with few intervals use one level, so their points are not multiplied. Which keys
    use several levels is a written table, so Catalyst knows whether it is small.
    """
    spans = intervals.filter(F.col(low).isNull() | F.col(high).isNull() | (F.col(low) < F.col(high))).withColumn(
        "_own_level", _level(F.col(low), F.col(high))
    )
    fine = materialize(
        spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.collect_set("_own_level").alias("_levels"))
        .filter(F.col("_n") > few).select(*keys, "_levels")
    )
    level = F.when(F.col("_levels").isNull(), _WHOLE).otherwise(F.col("_own_level"))
    first, last = _bin(F.col(low), F.col("_level")), _bin(F.col(high) - 1, F.col("_level"))
    pieces = (
        spans.join(fine, list(keys), "left").withColumn("_level", level)
        .withColumn("_bin", F.explode(F.sequence(first, last))).drop("_own_level", "_levels")
    )
    looked_up = (
        points.join(fine, list(keys), "left")
        .withColumn("_level", F.explode(F.coalesce("_levels", F.array(F.lit(_WHOLE)))))
        .withColumn("_bin", _bin(F.col(point), F.col("_level"))).drop("_levels")
    )
    return looked_up.join(pieces, [*keys, "_level", "_bin"]).filter(
        (F.col(low).isNull() | (F.col(point) >= F.col(low))) & (F.col(high).isNull() | (F.col(point) < F.col(high)))
    ).drop("_level", "_bin")

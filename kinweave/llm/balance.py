"""Mixing sources to target token counts by entropy balancing, in DataFrame functions only.

Sources weigh 5, 2, 1, repeating, in code point order with null last, and share SHARE of all tokens; a
target stops at LIMIT times its source's size and the excess is shared anew by weight.

Documents get rates between 0 and LIMIT. Of all rates that meet a source's token target, those nearest to
even ones in (two-sided) entropy are LIMIT * sigmoid(tilt * size): the convex dual has one tilt for each
source. Newton steps for all sources at once, guarded by brackets, need two sums for each source, taken
over counts of (source, size), so a step reads a histogram and never the documents. Rates become whole
copies by systematic rounding in cells of about CELL documents of a source: from large to small, a
document is taken as often as the running sum of rates passes a half, so a cell misses its tokens by half
its largest document at most. Everything is decided by hashes of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .quality import words_of

#: Weights of the sources in their order, share of all sizes, and the most copies (fixed values).
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
CELL = 4096
#: Largest relative miss of a token target by the rates.
TOLERANCE = 1e-8
_UNIT = 1 << 32


def _ordinals(sources: DataFrame) -> DataFrame:
    """``ordinal`` from 0 in code point order, null last; ranks within ranges and adds the ranges before."""
    order = F.col("source").asc_nulls_last()
    ranged = materialize(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    # one row for each range
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("held")).select(
        "part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.join(before, "part").select(*sources.columns, (F.col("before") + rank).alias("ordinal"))


def _targets(sources: DataFrame) -> DataFrame:
    """``target`` for sources with ``total``."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("ordinal", F.lit(len(WEIGHTS))).cast("int") + 1)
    sources = materialize(_ordinals(sources).withColumn("weight", weight))
    limit = F.col("total") * LIMIT
    whole = sources.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] * SHARE
    level, last = 0.0, None
    while level != last:
        last = level
        capped = limit <= F.col("weight") * level
        held, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))
        ).first()
        if open_weight:
            level = max(level, (whole - held) / open_weight)
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.sum((x * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def _tilts(sources: DataFrame, histogram: DataFrame) -> DataFrame:
    """``tilt`` for each source: Newton on the dual, all sources in one aggregation per step.

    Null where no tilt is needed: every document at the limit, or no words.
    """
    share = F.col("target") / (F.col("total") * LIMIT)
    inner = (F.col("total") > 0) & (F.col("target") < F.col("total") * LIMIT)
    # exact where all sizes are alike
    start = F.when(inner, F.log(share / (1 - share)))
    state = materialize(sources.select(
        "*", start.alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
    ))
    kinds = dict(state.dtypes)
    while True:
        x = F.col("size") / F.col("mean")
        p = sigmoid(F.col("tilt") * x)
        tokens = F.col("n") * F.col("size") * LIMIT
        sums = histogram.withColumnRenamed("source", "own").join(
            state.filter("tilt is not null").select("source", "tilt", "mean"), F.col("own").eqNullSafe(F.col("source"))
        ).groupBy("source").agg(_exact_sum(tokens * p).alias("value"), _exact_sum(tokens * p * (1 - p) * x).alias("slope"))
        sums = sums.withColumnRenamed("source", "own")
        joined = state.join(sums, F.col("own").eqNullSafe(F.col("source")), "left").drop("own")
        miss = F.col("value") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - miss / F.col("slope")
        middle = F.when(F.col("low") == float("-inf"), F.col("high") - 1 - F.abs("high")).when(
            F.col("high") == float("inf"), F.col("low") + 1 + F.abs("low")
        ).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.abs(miss) <= F.col("target") * TOLERANCE
        stuck = (F.col("high") - F.col("low")) <= F.abs("tilt") * 1e-15
        joined = joined.withColumn("low", low).withColumn("high", high).withColumn("moves", F.coalesce(~done & ~stuck, F.lit(False)))
        moved = F.when(~F.col("moves"), F.col("tilt")).when(
            (step > F.col("low")) & (step < F.col("high")), step
        ).otherwise(middle)
        state = materialize(joined.withColumn("next", moved).select(
            *[F.col("next" if c == "tilt" else c).cast(kinds[c]).alias(c) for c in kinds], "moves"
        ))
        if state.filter("moves").isEmpty():
            return state.drop("low", "high", "moves")
        state = state.drop("moves")


def plan(rows: DataFrame) -> DataFrame:
    """One row per source of (source, size) rows: total, documents, mean, target and tilt."""
    histogram = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = histogram.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("documents"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("with_words"),
    ).withColumn("mean", F.col("total") / F.col("with_words"))
    return _tilts(_targets(sources), histogram.filter("size > 0"))


def with_copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rate`` and ``copies`` for rows with id, source and size; other columns stay.

    Documents without words have rate 1: they change no token count.
    """
    joined = rows.join(
        sources.withColumnRenamed("source", "own"), F.col("own").eqNullSafe(F.col("source"))
    ).drop("own")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(
        F.col("tilt").isNull(), F.lit(float(LIMIT))
    ).otherwise(LIMIT * sigmoid(F.col("tilt") * F.col("size") / F.col("mean")))
    cells = F.ceil(F.col("documents") / CELL)
    joined = joined.withColumn("rate", rate).withColumn("cell", F.pmod(F.xxhash64("id", "size"), cells)).withColumn(
        "part", F.round((F.col("rate") - F.floor("rate")) * _UNIT).cast("bigint")
    )
    cell = Window.partitionBy("source", "cell").orderBy(F.col("size").desc(), F.xxhash64("id"), "id")
    upto = F.sum("part").over(cell.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    half = _UNIT // 2
    extra = F.floor((upto + half) / _UNIT) - F.floor((upto - F.col("part") + half) / _UNIT)
    return joined.withColumn("copies", (F.floor("rate") + extra).cast("int")).drop("cell", "part")


def sized(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, row): size in words, and all columns of ``df`` in a struct."""
    return df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.size(words_of(F.col(text_col))).cast("bigint").alias("size"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )


def mix_report(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words for every row, with rate and copies.

    A null text has size 0, null sources are one source and repeated rows are documents of their own. An
    empty table gives an empty result.
    """
    rows = materialize(sized(df).drop("row"))
    return with_copies(rows, plan(rows)).select(
        F.col("id").alias("doc_id"), "size", F.col("total").alias("source_size"), "target",
        (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies",
    )


def mixed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    sources = plan(materialize(sized(df).select("source", "size")))
    taken = with_copies(sized(df), sources).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

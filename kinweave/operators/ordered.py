"""Ordered operators that stay parallel when one key holds most of the rows.

Rows are cut into position chunks of about equal size over the whole input. A chunk of one key is
then a bounded group, a window runs inside it, and only one summary row per (key, chunk) takes
part in the hand-over from chunk to chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_CHUNK = 4_000_000
ROWS_PER_PIECE = 4096
PIECES_PER_BLOCK = 4096
CHUNK = "_chunk"


def position_cuts(df: DataFrame, position: str, rows_per_chunk: int, n_rows: int | None = None) -> list[float]:
    """Positions that cut the rows into chunks of at most about ``rows_per_chunk``.

    Empty when everything fits one chunk. ``n_rows`` spares the count where a bound is known.
    """
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= rows_per_chunk:
        return []
    chunks = math.ceil(n_rows / rows_per_chunk)
    quantiles = [i / chunks for i in range(1, chunks)]
    cuts = df.select(F.col(position).cast("double").alias("p")).approxQuantile("p", quantiles, 1 / (4 * chunks))
    return sorted(set(cuts))


def with_chunk(df: DataFrame, position: str, cuts: Sequence[float], name: str = CHUNK) -> DataFrame:
    """Number of the chunk a position falls into; monotone in the position."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    bucketizer = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_position", outputCol="_bucket"
    )
    return (
        bucketizer.transform(df.withColumn("_position", F.col(position).cast("double")))
        .withColumn(name, F.col("_bucket").cast("int"))
        .drop("_position", "_bucket")
    )


def _window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def previous_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    cuts: Sequence[float] = (),
    position: str | None = None,
) -> DataFrame:
    """Latest non-null ``value`` strictly before each row, per key in ``order``.

    ``order`` must be total inside a key. With ``cuts`` the work of one key is spread over chunks
    of ``position``, which must be the first order column.
    """
    if not cuts:
        before = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(before))
    keyed = [*keys, CHUNK]
    df = with_chunk(df, position or order[0], cuts)
    summary = df.groupBy(*keyed).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last")
    )
    before = _window(keys, [CHUNK]).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keyed, F.last("_last", ignorenulls=True).over(before).alias("_carried")
    )
    inside = _window(keyed, order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(out, F.last(value, ignorenulls=True).over(inside))
        .join(carried, keyed, "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_carried")))
        .drop("_carried", CHUNK)
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    cuts: Sequence[float] = (),
    position: str | None = None,
) -> DataFrame:
    """1-based rank of each row inside its key, spread over position chunks like above."""
    if not cuts:
        return df.withColumn(out, F.row_number().over(_window(keys, order)))
    keyed = [*keys, CHUNK]
    df = with_chunk(df, position or order[0], cuts)
    before = _window(keys, [CHUNK]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keyed).agg(F.count(F.lit(1)).alias("_n")).select(
        *keyed, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        df.withColumn(out, F.row_number().over(_window(keyed, order)))
        .join(offsets, keyed)
        .withColumn(out, (F.col(out) + F.col("_offset")).cast("int"))
        .drop("_offset", CHUNK)
    )


def take_while_inclusive(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], predicate: Column
) -> DataFrame:
    """Per key: rows up to and including the first that fails the predicate (D9); null fails like false.

    The first failure is a map-side combined minimum, so no key is ever sorted or held whole.
    """
    position = F.struct(*order)
    ends = df.filter(~F.coalesce(predicate, F.lit(False))).groupBy(*keys).agg(F.min(position).alias("_end"))
    return (
        df.join(ends, list(keys), "left")
        .filter(F.col("_end").isNull() | (position <= F.col("_end")))
        .drop("_end")
    )


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    out: str,
    cuts: Sequence[float] = (),
    position: str | None = None,
    separator: str = "",
) -> DataFrame:
    """Fold by concatenation in order (D10): first inside each chunk, then over the chunks."""
    df = with_chunk(df, position or order[0], cuts)
    pieces = df.groupBy(*keys, CHUNK).agg(
        F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))).alias("_rows")
    ).select(*keys, CHUNK, F.array_join(F.col("_rows._text"), separator).alias("_piece"))
    return pieces.groupBy(*keys).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct(CHUNK, "_piece")))["_piece"], separator
        ).alias(out)
    )


def ordered_pieces(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    cuts: Sequence[float] = (),
    position: str | None = None,
    separator: str = "",
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """The same fold (D10) stored in pieces: (keys, piece, start, text), ``start`` in characters of the whole.

    No cell grows with its key: a piece holds ``rows_per_piece`` rows. Pieces of a key in order are its fold;
    those after the first begin with the separator. Starts are exclusive prefix sums of the lengths, first
    within blocks of pieces, then over the blocks. Null texts are passed over as in ``ordered_concat``; a key
    without any text has no piece. ``order`` must be total inside a key.
    """
    rows = with_chunk(df.filter(F.col(text).isNotNull()), position or order[0], cuts)
    counts = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_all"))
    ranked = _with_sum_before(
        rows.withColumn("_n", F.row_number().over(_window([*keys, CHUNK], order)) - 1), counts, keys, CHUNK, "_n"
    )
    pieces = ranked.groupBy(*keys, F.expr(f"_n div {rows_per_piece}").alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("_text"))))["_text"], separator).alias("text")
    ).select(*keys, "piece", F.when(F.col("piece") > 0, F.concat(F.lit(separator), "text")).otherwise(F.col("text")).alias("text"))
    sized = pieces.withColumn("_block", F.expr(f"piece div {PIECES_PER_BLOCK}")).withColumn("_length", F.length("text").cast("bigint"))
    inside = _window([*keys, "_block"], ["piece"]).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.coalesce(F.sum("_length").over(inside), F.lit(0)))
    blocks = sized.groupBy(*keys, "_block").agg(F.sum("_length").alias("_all"))
    return _with_sum_before(placed, blocks, keys, "_block", "start").select(*keys, "piece", "start", "text")


def _with_sum_before(df: DataFrame, parts: DataFrame, keys: Sequence[str], part: str, value: str) -> DataFrame:
    """Adds to ``value`` what the earlier parts of its key hold (``_all``); one row per key and part meets in a window."""
    before = _window(keys, [part]).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(*keys, part, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before")).alias("_r")
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in (*keys, part)]
    joined = df.alias("_l").join(sums, same).select("_l.*", "_r._before")
    return joined.withColumn(value, (F.col(value) + F.col("_before")).cast("bigint")).drop("_before")


def latest(order: Sequence[str], value: Column) -> Column:
    """Aggregate: the value of the last row in order (map-side combined)."""
    return F.max_by(value, F.struct(*order))

"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Rules read words ``[^\\x20\\x09-\\x0D]+`` of whole texts. The ratio compares two multinomials over
2**BUCKET_BITS hashed one- and two-word grams: trusted documents (labels of quality 1) against the raw
corpus. A text's score is the mean log ratio of its grams; it is kept at the threshold or above, the
KEPT_SHARE quantile of the trusted documents set aside for that.

Raw counts cover every row and target counts every trusted row not set aside, summed before the exchange, so
only one row per bucket and task moves. The weights are one array of fixed length, read by a scalar subquery.
Every row is scored once; the threshold is read from the written scores, so no text moves for it. Texts are
exchanged by id once, to meet the trusted ids. Everything that needs a whole text happens inside its row:
windows that repeat are neighbours in a sorted array of hashes with their positions, and equal hashes are
compared word by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

BUCKET_BITS = 16
CALIBRATION_FOLDS = 5
SMOOTHING = 1.0
#: Log ratios are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Share of trusted documents under the threshold.
KEPT_SHARE = 0.01
#: Scores are counted in cells of 1 / CELLS to find the one of the threshold.
CELLS = 256
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: White space and symbols of the rules (fixed values).
SPACE = " \t\n\x0b\x0c\r"
SPLIT_AT = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT_AT))


def _with_rules(rows: DataFrame) -> DataFrame:
    """``words`` and the rule counts for rows with ``text``."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn(
        "lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(HAS_WORD))
    ).withColumn("symbols", F.size(F.split(text, SYMBOLS, -1)) - 1)
    # hash of the window in the high bits, its position in the low ones
    rows = rows.withColumn("n", F.size("words")).withColumn("low_bits", F.length(F.bin("n"))).withColumn("windows", F.expr("""
        sort_array(transform(
            if(n < 3, cast(array() as array<int>), sequence(0, n - 3)),
            i -> coalesce(shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), low_bits) | bigint(i), 0L)))
    """))
    same = """(shiftright(x, low_bits) = shiftright({y}, low_bits)
        and words[int(x & mask)] = words[int({y} & mask)] and words[int(x & mask) + 1] = words[int({y} & mask) + 1]
        and words[int(x & mask) + 2] = words[int({y} & mask) + 2])"""
    rows = rows.withColumn("mask", F.expr("shiftleft(1L, low_bits) - 1")).withColumn("repeats", F.expr(f"""
        sort_array(transform(
            filter(windows, (x, i) -> (i > 0 and {same.format(y='windows[i - 1]')})
                or (i + 1 < size(windows) and {same.format(y='windows[i + 1]')})),
            x -> coalesce(int(x & mask), 0)))
    """))
    # a window covers three words, fewer where the next repeated window starts sooner
    covered = F.expr("""
        aggregate(repeats, struct(0L as n, -3 as last),
            (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)
    """)
    return rows.select(
        "*", F.col("n").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.col("symbols").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
    )


def _grams() -> Column:
    """Buckets of the one- and two-word grams of ``words``."""
    n = 1 << BUCKET_BITS
    return F.expr(f"""
        concat(transform(words, w -> int(pmod(xxhash64(w), {n}L))),
               transform(if(size(words) < 2, cast(array() as array<int>), sequence(0, size(words) - 2)),
                         i -> int(pmod(xxhash64(words[i], words[i + 1]), {n}L))))
    """)


def _trusted(labels: DataFrame) -> DataFrame:
    """(id, calibrates): the ids of quality 1; those that calibrate are set aside for the threshold."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
    return good.select("id", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(CALIBRATION_FOLDS)) == 0).alias("calibrates"))


def _bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    """How often each bucket comes up in the texts of ``rows``."""
    grams = rows.select(words_of(F.col("text")).alias("words")).select(F.explode(_grams()).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gram_weights(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: the fixed-point log ratios of all 2**BUCKET_BITS buckets, in their order; all 0 without trusted grams."""
    size = 1 << BUCKET_BITS
    counts = _bucket_counts(rows, "raw")
    # the trusted ids grow with the labels, so texts are exchanged once rather than ids sent to all tasks
    learned = rows.join(trusted.filter(~F.col("calibrates")).select("id").hint("merge"), "id", "left_semi")
    counted = materialize(counts.join(_bucket_counts(learned, "target"), "bucket", "left").fillna(0, "target"))
    target, raw = counted.agg(F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("raw"), F.lit(0))).first()
    all_buckets = rows.sparkSession.range(size).withColumnRenamed("id", "bucket").join(F.broadcast(counted), "bucket", "left")

    def share(column, total):
        return F.log((F.coalesce(column, F.lit(0)) + SMOOTHING) / F.lit(total + SMOOTHING * size))

    ratio = share(F.col("target"), target) - share(F.col("raw"), raw) if target else F.lit(0.0)
    weighted = all_buckets.select("bucket", F.round(ratio * UNIT).cast("bigint").alias("w"))
    pairs = F.sort_array(F.collect_list(F.struct("bucket", "w")))
    return materialize(weighted.agg(F.transform(pairs, lambda p: p["w"]).alias("weights")))


def _scores(rows: DataFrame, weights: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns and ``score`` for rows with ``words``: the mean weight of the grams, 0 without any.

    Grams are summed in the task that has the row, as whole numbers, so the order does not matter.
    """
    rows = rows.select(F.monotonically_increasing_id().alias("row"), *kept, _grams().alias("grams"))
    grams = rows.select("row", *kept, F.explode_outer("grams").alias("gram"))
    weight = F.get(weights.select("weights").scalar(), F.col("gram"))
    summed = grams.withColumn("weight", weight).groupBy("row").agg(
        *[F.first(c).alias(c) for c in kept], F.sum("weight").alias("total"), F.count("gram").alias("n_grams")
    )
    mean = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams") / F.lit(float(UNIT))).otherwise(F.lit(0.0))
    return summed.select(*kept, mean.alias("score"))


def _quantile(scores: DataFrame, share: float) -> float | None:
    """The exact quantile of ``score``, between two scores in proportion; None without scores.

    Scores are counted by cells, and only the cells of the one or two scores that are asked for are sorted.
    """
    cells = scores.groupBy(F.floor(F.col("score") * CELLS).alias("cell")).agg(F.count(F.lit(1)).alias("n")).sort("cell").collect()
    if not cells:
        return None
    place = share * (sum(cell.n for cell in cells) - 1)
    low, high, before, wanted = math.floor(place), math.ceil(place), 0, {}
    for cell, n in cells:
        wanted |= {rank: (cell, rank - before) for rank in (low, high) if before <= rank < before + n}
        before += n

    def at(rank):
        cell, skipped = wanted[rank]
        own = scores.filter(F.floor(F.col("score") * CELLS) == cell)
        return own.select("score").sort("score").offset(skipped).first()[0]

    first = at(low)
    return first if high == low else first + (place - low) * (at(high) - first)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: rule counts, base_failed, score, and whether the text is kept.

    ``labels`` has doc_id and quality. Null and empty texts have no words and fail the rules. Null ids and
    repeated rows are judged like others. Without trusted documents every score is 0 and only rules decide;
    an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    trusted = materialize(_trusted(labels))
    weights = gram_weights(rows, trusted)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = materialize(_scores(_with_rules(rows), weights, ["id", *counts]))
    aside = scored.select("id", "score").join(trusted.filter("calibrates").select("id"), "id", "left_semi")
    threshold = _quantile(aside, KEPT_SHARE)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = F.col("score") >= F.lit(threshold) if threshold is not None else F.lit(True)
    return scored.select(
        F.col("id").alias(id_col), *counts, failed.alias("base_failed"), (~failed & verdict).alias("kept"), "score"
    )

"""Which sources of a language differ, and by which terms: chi-square like shares ranked by count cells.

A term is a run of ASCII letters and characters beyond ASCII. A term of a language is kept if enough of its
documents have it. Every (lang, source) group and every language as a whole gives each kept term a share in
billionths, smoothed by one occurrence; two shares differ by f = (p - q)^2 / q. All arithmetic is exact.

f of a term depends on two counts only, so nothing is evaluated or ranked term by term:

* Terms against the language: terms of a group are counted by (group count, lang count). f is evaluated once
  for each such cell, cells of equal f are merged, and the merged cells are ranked by f with their cumulative
  multiplicity. Only cells that reach into the top ranks are expanded into terms, in UTF-8 order.
* Source against source: terms that have the same counts in all sources are one row with a multiplicity.
  From these rows come the cells (count here, count there) in which both counts are positive. What
  is left has a zero on one side or both and follows from each source's own counts of counts:
  the sum of f over all kept terms is the sum of f(a, b) - f(a, 0) - f(0, b) + f(0, 0) over those cells, plus
  f(a, 0) - f(0, 0) and f(0, b) - f(0, 0) over the counts of one source each, plus V f(0, 0).

Terms are counted within Arrow batches, so a term as frequent as may be reaches a shuffle as one row for each
batch, group and term. Texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .rawtext import LOWER, slices, string_array, text_buffer, word_spans

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
BLOCK_BYTES = 8_000_000

#: A term has ASCII letters and bytes beyond ASCII (fixed values: [^\x00-\x40\x5B-\x60\x7B-\x7F]).
IS_TERM = np.ones(256, bool)
IS_TERM[0x00:0x41] = IS_TERM[0x5B:0x61] = IS_TERM[0x7B:0x80] = False

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _block_counts(part: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents of the block's (lang, source, term), and a row without term for each group."""
    data, offsets = text_buffer(part.column("text"))
    starts, ends, cuts = word_spans(data, offsets, IS_TERM)
    spans = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=spans[1:])
    found = string_array(LOWER[data[IS_TERM[data]]], spans).dictionary_encode()
    term, names = found.indices.to_numpy(), found.dictionary
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    groups, group = np.unique(
        lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True
    )
    row = np.repeat(np.arange(part.num_rows), np.diff(cuts))
    width = max(len(names), 1)
    held, times = np.unique(row * width + term, return_counts=True)
    keys, place = np.unique(group[held // width] * width + held % width, return_inverse=True)
    n = np.bincount(place, times, len(keys)).astype(np.int64)
    docs = np.bincount(place, minlength=len(keys))
    of = np.concatenate([groups[keys // width], groups])
    blank = np.zeros(len(groups), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(pa.array(of // len(source.dictionary))),
            source.dictionary.take(pa.array(of % len(source.dictionary))),
            pa.concat_arrays([names.take(pa.array(keys % width)), pa.nulls(len(groups), names.type)]).cast(pa.string()),
            pa.array(np.concatenate([n, blank])), pa.array(np.concatenate([docs, blank])),
        ],
        ["lang", "source", "term", "n", "docs"],
    )


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that have the term; one row of null term for each group.

    Nulls count as empty strings. Rows that repeat count each time.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK_BYTES):
            if part.num_rows:
                yield _block_counts(part)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    return rows.mapInArrow(count, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts beyond 64 bits times SCALE."""
    above = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("bigint") + _div(above, (total + terms).cast("decimal(20,0)"))


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares stay under 2^31 or so, so the square fits in 64 bits."""
    return _div((p - q) * (p - q), q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


class Audit:
    """Tables of one audit: counts, kept terms and groups, each written once."""

    def __init__(
        self, df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
        min_docs: int = MIN_DOCS, top: int = TOP,
    ):
        self.top = top
        counts = materialize(term_counts(df, text_col, lang_col, source_col))
        #: lang, term, total, held: the sources that have the term, each with its count
        self.kept = materialize(
            counts.filter("term is not null").groupBy("lang", "term").agg(
                F.sum("n").alias("total"), F.sum("docs").alias("docs"),
                F.sort_array(F.collect_list(F.struct("source", "n"))).alias("held"),
            ).filter(F.col("docs") >= min_docs).drop("docs")
        )
        langs = self.kept.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
        own = self._held("source", "n").groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
        #: lang, source, source_total, lang_total, terms: every group, with or without kept terms
        self.groups = materialize(
            counts.filter("term is null").select("lang", "source").join(own, ["lang", "source"], "left")
            .join(langs, "lang", "left").fillna(0, ["source_total", "lang_total", "terms"])
        )

    def _held(self, *columns: str) -> DataFrame:
        rows = self.kept.select("lang", "term", "total", F.explode("held").alias("h"))
        return rows.select("lang", "term", "total", "h.source", "h.n").select("lang", *columns)

    def source_pairs(self) -> DataFrame:
        """(lang, source, item, value): f against each other source of the language, summed over its kept terms."""
        here = self.groups.select("lang", "source", F.col("source_total").alias("n1"), "terms")
        there = self.groups.select("lang", F.col("source").alias("item"), F.col("source_total").alias("n2"))
        big = lambda c: c.cast("decimal(38,0)")
        zero = F.lit(0).cast("bigint")

        def f(a: Column, b: Column) -> Column:
            return big(difference(share(a, F.col("n1"), F.col("terms")), share(b, F.col("n2"), F.col("terms"))))

        pairs = here.join(there, "lang").filter("source <> item")
        none = pairs.select("lang", "source", "item", F.when(F.col("terms") > 0, big(F.col("terms")) * f(zero, zero)).alias("part"))
        counts = self._held("source", "n").groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
        # a count of one source, as if the other had none of these terms
        own = counts.join(here, ["lang", "source"]).join(there, "lang").filter("source <> item")
        own = own.select("lang", "source", "item", (big(F.col("m")) * (f(F.col("n"), zero) - f(zero, zero))).alias("part"))
        theirs = counts.withColumnRenamed("source", "item").join(there, ["lang", "item"]).join(here, "lang").filter("source <> item")
        theirs = theirs.select("lang", "source", "item", (big(F.col("m")) * (f(zero, F.col("n")) - f(zero, zero))).alias("part"))
        # terms alike in all sources are one row before sources meet
        alike = self.kept.groupBy("lang", "held").agg(F.count(F.lit(1)).alias("m"))
        cells = (
            alike.select("lang", "m", "held", F.explode("held").alias("a"))
            .select("lang", "m", "a", F.explode("held").alias("b")).filter("a.source <> b.source")
            .groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.n").alias("a"), F.col("b.n").alias("b"))
            .agg(F.sum("m").alias("m"))
        )
        a, b = F.col("a"), F.col("b")
        both = cells.join(here, ["lang", "source"]).join(there, ["lang", "item"]).select(
            "lang", "source", "item",
            (big(F.col("m")) * (f(a, b) - f(a, zero) - f(zero, b) + f(zero, zero))).alias("part"),
        )
        return none.unionByName(own).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(
            F.coalesce(F.sum("part"), F.lit(0)).cast("bigint").alias("value")
        )

    def telling_terms(self) -> DataFrame:
        """(lang, source, item, value, rank): the terms a source has more of than its language, up to rank ``top``."""
        p = share(F.col("n"), F.col("source_total"), F.col("terms"))
        q = share(F.col("total"), F.col("lang_total"), F.col("terms"))
        cells = (
            self._held("source", "n", "total").groupBy("lang", "source", "n", "total").agg(F.count(F.lit(1)).alias("m"))
            .join(self.groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).filter("p > q")
            .select("lang", "source", "n", "total", "m", difference(F.col("p"), F.col("q")).alias("value"))
        )
        group = Window.partitionBy("lang", "source")
        # each value has a term at least, so values beyond the first ``top`` cannot be in
        values = (
            cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
            .withColumn("at", F.row_number().over(group.orderBy(F.desc("value")))).filter(F.col("at") <= self.top)
            .withColumn("before", F.sum("m").over(group.orderBy("at")) - F.col("m"))
            .filter(F.col("before") < self.top).select("lang", "source", "value", "before")
        )
        chosen = materialize(cells.join(values, ["lang", "source", "value"]).drop("m"))
        terms = self._held("source", "n", "total", "term").join(chosen, ["lang", "source", "n", "total"])
        tied = Window.partitionBy("lang", "source", "value").orderBy("term")
        return (
            terms.withColumn("at", F.row_number().over(tied)).filter(F.col("at") <= self.top)
            .withColumn("rank", F.col("before") + F.col("at")).filter(F.col("rank") <= self.top)
            .select("lang", "source", F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
        )


def divergence_report(df: DataFrame, **options) -> DataFrame:
    """(lang, source, part, item, value, rank): source pairs and telling terms of every group, ranked.

    Null and empty texts, langs and sources are empty strings and form groups of their own. A group without
    kept terms still meets the other sources of its language. An empty table gives no rows.
    """
    audit = Audit(df, **options)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = audit.source_pairs().withColumn("rank", F.row_number().over(order))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        audit.telling_terms().withColumn("part", F.lit("term")).select(*columns)
    )


#: The report in DuckDB's SQL, term by term.
SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
    FROM documents
),
occurrences AS (SELECT r, lang, source, unnest(found) AS term FROM docs),
kept AS (
    SELECT lang, term, count(*)::HUGEINT AS total FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= 3
),
held AS (
    SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM occurrences o JOIN kept USING (lang, term) GROUP BY ALL
),
langs AS (SELECT lang, sum(total)::HUGEINT AS lang_total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS source_total FROM held GROUP BY ALL),
groups AS (
    SELECT DISTINCT d.lang, d.source, coalesce(t.source_total, 0)::HUGEINT AS source_total
    FROM docs d LEFT JOIN totals t USING (lang, source)
),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
           1 + (1000000000 * (coalesce(h.n, 0) + 1)) // (g.source_total + l.v) AS p,
           1 + (1000000000 * (k.total + 1)) // (l.lang_total + l.v) AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN held h USING (lang, source, term)
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum((s.p - t.p) * (s.p - t.p) // t.p), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares s ON s.lang = a.lang AND s.source = a.source
    LEFT JOIN shares t ON t.lang = b.lang AND t.source = b.source AND t.term = s.term
    WHERE s.term IS NULL OR t.term IS NOT NULL
    GROUP BY ALL
),
terms AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value,
           row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term' AS part, item, value,
           row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
    QUALIFY rank <= 200
)
SELECT lang, source, part, item, value, rank FROM ranked
"""

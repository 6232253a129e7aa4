import re
from collections import Counter, defaultdict

import duckdb

from kinweave.llm import divergence
from tests.llm.samples import awkward_rows, empty, frame, lowered

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(lowered(text))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // total for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[u][t]) for t in kept), u.encode()) for u in sources if u != s]
            terms = [(-f(own[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)}
    return out


def rows():
    """Three languages; ties beyond the last rank, a source without terms, a language without kept terms."""
    many = [(900 + i, " ".join(f"tie{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), "xx", "s1", 1) for i in range(3)]
    blank = [(910, "1 2 3", "xx", "s2", 1), (911, None, "xx", "s3", 1), (912, "lonely", "yy", "s1", 1), (913, "", "yy", "s2", 1)]
    return awkward_rows() + many + blank + [(914, "ÄÖ Straße straße STRASSE \U0001d11e漢 a_b-c", "xx", "s2", 1)] * 4


def test_report_equals_brute_force(spark):
    got = [tuple(r) for r in divergence.divergence_report(frame(spark, rows(), True)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows())
    assert sum(r[:3] == ("xx", "s1", "term") for r in got) == 200
    assert {r[4] for r in got if r[0] == "yy"} == {0}
    assert divergence.divergence_report(empty(spark)).count() == 0


def test_options(spark):
    got = divergence.divergence_report(frame(spark, rows()), min_docs=1, top=5).collect()
    assert set(map(tuple, got)) == brute(rows(), 1, 5)


def test_sql_equals_the_report(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(divergence.SQL).fetchall()
    got = divergence.divergence_report(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_counts_beyond_64_bits_times_the_scale(spark):
    from pyspark.sql import functions as F

    n, total, terms = 12_345_678_901_234, 98_765_432_109_876, 1_234_567
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + terms)

"""Every stage against a plain account of what it may keep, on the smallest tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import balance, packing
from kinweave.session import materialize
from tests.llm.samples import awkward_rows, frame
from tests.llm.test_packing import encoding, unpacked
from tests.llm.test_simhash import components, fingerprint
from tests.llm.test_tiling import greedy, plain_words


@pytest.fixture(scope="module")
def tables(spark, sf):
    """What each stage was given and returned."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf)))
    return out


def test_columns_stay(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_language_keeps_documents_with_letters(tables):
    kept = {r.doc_id for r in tables[1].collect()}
    lost = [r for r in tables[0].collect() if r.doc_id not in kept]
    assert len(lost) <= 0.02 * tables[0].count()


def test_one_document_of_each_group(tables):
    rows = tables[1].collect()
    low = components([(r.doc_id, fingerprint(r.text)) for r in rows])
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted(set(low))


def test_leaking_documents_go(tables, spark, sf):
    items = [plain_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    keep = []
    for r in tables[2].collect():
        words = plain_words(r.text)
        grams = {tuple(words[k:k + 4]) for k in range(len(words) - 3)}
        near = [i for i in items if sum(tuple(i[k:k + 4]) in grams for k in range(len(i) - 3)) > 0]
        if not any(greedy(i, words) >= 0.5 * len(i) for i in near):
            keep.append(r.doc_id)
    assert sorted(r.doc_id for r in tables[3].collect()) == sorted(keep)
    assert len(keep) < tables[2].count()


def test_mix_takes_the_reported_copies(tables):
    want = {r.doc_id: r.copies for r in balance.mix_report(tables[3]).collect()}
    got = Counter(r.doc_id for r in tables[4].collect())
    assert got == Counter({i: n for i, n in want.items() if n})


def test_packed_rows_hold_every_document(tables):
    plain, want = encoding(), {}
    for r in tables[4].collect():
        ids = [*plain.encode_ordinary(r.text), packing.END_ID]
        want.setdefault(r.doc_id, []).extend((p, ids[a:b]) for p, (a, b) in enumerate(packing.split(len(ids))))
    got = unpacked(tables[5].collect(), packing.ROW)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_run_returns_the_last_table(tables, spark, sf):
    ids = lambda df: np.sort(np.concatenate([np.array(r.doc_ids) for r in df.collect()]))
    assert np.array_equal(ids(corpus_pipeline.run(spark, sf)), ids(tables[5]))


def test_awkward_rows(spark, tmp_path):
    rows = awkward_rows()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, "a b c d e f")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [frame(spark, rows)]
    for _, stage in corpus_pipeline.STAGES[:3]:
        left.append(materialize(stage(spark, left[-1], str(tmp_path))))
    _, spoken, single, clean = [[(r.doc_id, r.text) for r in t.collect()] for t in left]
    low = components([(i, fingerprint(t)) for i, t in spoken])
    lone = {fingerprint(t) for (_, t), c in zip(spoken, low) if c is None}
    named = sorted({c for c in low if c is not None})
    assert sorted(i for i, _ in single if i is not None) == named
    assert {fingerprint(t) for i, t in single if i is None} == lone
    # no row holds the only item of the benchmark
    assert sorted(clean, key=str) == sorted(single, key=str)
    assert {i for r in corpus_pipeline.run(spark, str(tmp_path)).collect() for i in r.doc_ids} <= {i for i, _ in clean}
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).agg(F.count("*")).first()[0] == 0

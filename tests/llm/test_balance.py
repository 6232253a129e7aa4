import math

import pytest
from pyspark.sql import functions as F

from kinweave.llm import balance
from tests.llm.samples import awkward_rows, empty, frame, words


def targets(totals):
    """Shares by weight; sources above twice their size are cut, the rest shares again, until none is above."""
    order = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    weight = {s: balance.WEIGHTS[i % 3] for i, s in enumerate(order)}
    whole, cut = 1.5 * sum(totals.values()), {}
    while True:
        free = [s for s in order if s not in cut]
        level = (whole - sum(cut.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level >= 2 * totals[s]]
        if not above:
            return cut | {s: weight[s] * level for s in free}
        cut |= {s: 2.0 * totals[s] for s in above}


def check(rows, got):
    sizes = [len(words(r[1])) for r in rows]
    totals = {}
    for r, n in zip(rows, sizes):
        totals[r[3]] = totals.get(r[3], 0) + n
    want = targets(totals)
    assert sorted(((r[0], n, totals[r[3]]) for r, n in zip(rows, sizes)), key=str) == sorted(
        ((g.doc_id, g.size, g.source_size) for g in got), key=str)
    by = {}
    for g in got:
        assert 0 <= g.taken <= 2 * g.size and g.taken == g.copies * g.size
        assert g.target == pytest.approx(min((t for t in want.values() if abs(t - g.target) <= 1e-6 * (1 + t)), default=-1), rel=1e-9, abs=1e-9)
        by.setdefault((g.source_size, g.target), []).append(g)
    for (total, target), group in by.items():
        expected = sum(g.rate * g.size for g in group)
        assert expected == pytest.approx(target, rel=1e-6, abs=1e-6)
        cells = math.ceil(len(group) / balance.CELL)
        assert abs(sum(g.taken for g in group) - target) <= 0.5 * cells * max(g.size for g in group) + 1
    return by


@pytest.mark.parametrize("clash", [False, True])
def test_awkward_rows(spark, clash):
    rows = awkward_rows()
    check(rows, balance.mix_report(frame(spark, rows, clash)).collect())
    assert balance.mix_report(empty(spark)).count() == 0


def test_documents_and_reruns(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, None, r.source) for r in df.collect()]
    got = balance.mix_report(df).collect()
    check(rows, got)
    again = balance.mix_report(df.repartition(7).orderBy(F.rand(3))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    monkeypatch.setattr(balance, "CELL", 16)
    check(rows, balance.mix_report(df).collect())


def test_rates_are_tilted_exponentially(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = {}
    for r in balance.mix_report(df).collect():
        if 0 < r.rate < 2:
            groups.setdefault((r.target, r.source_size), []).append((r.size, math.log(r.rate / (2 - r.rate))))
    assert groups
    for points in groups.values():
        tilts = [y / x for x, y in points if x and abs(y) < 20]
        assert max(tilts) == pytest.approx(min(tilts), rel=1e-6, abs=1e-7)


def test_mixed_repeats_rows(spark):
    rows = awkward_rows()
    df = frame(spark, rows, True)
    copies = sum(r.copies for r in balance.mix_report(df).collect())
    out = balance.mixed(df)
    assert out.columns == df.columns and out.count() == copies
    assert balance.mixed(empty(spark)).count() == 0

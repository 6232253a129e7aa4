import math
import random
import re
from collections import Counter

import pytest
import xxhash

from kinweave.llm import quality
from tests.llm.samples import awkward_rows, empty, frame, words


def rules(text):
    seq = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = [tuple(seq[i:i + 3]) for i in range(len(seq) - 2)]
    counts = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    return (len(seq), sum(map(len, seq)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def spark_hash(*parts):
    """xxhash64 of several strings, as an unsigned number."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed


def buckets(text):
    seq = words(text)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [signed(spark_hash(*g)) % (1 << quality.BUCKET_BITS) for g in [(w,) for w in seq] + list(zip(seq, seq[1:]))]


def quality_rows():
    rows, rng = awkward_rows(7), random.Random(9)
    common = ["c%d" % k for k in range(40)]
    for i in range(500, 640):
        body = " ".join(rng.choices(common, k=90)) if i % 3 else " ".join("buy### now$$$%d <b>|</b>%d" % (k * i, k) for k in range(40))
        rows.append((i, body + "tail %d" % i + "\n\nsame\n same\nsame", "en", "a", 1))
    labels = [(i, 1 if i % 3 else 0, 0) for i in range(500, 640)] + [(None, 1, 0), (501, 1, 0), (9999, 1, 0), (502, None, None)]
    return rows, labels


@pytest.mark.parametrize("clash", [False, True])
def test_columns_equal_brute_force(spark, clash):
    rows, labels = quality_rows()
    label_frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    trusted = {r.id: r.calibrates for r in quality._trusted(label_frame).collect()}
    raw, target = Counter(), Counter()
    for i, text, *_ in rows:
        raw.update(buckets(text))
        if i in trusted and not trusted[i]:
            target.update(buckets(text))
    size = 1 << quality.BUCKET_BITS
    t, r = sum(target.values()), sum(raw.values())

    def score(text):
        own = buckets(text)
        units = [round((math.log((target[b] + 1) / (t + size)) - math.log((raw[b] + 1) / (r + size))) * quality.UNIT) for b in own]
        return sum(units) / quality.UNIT / len(own) if own else 0.0

    aside = sorted(score(x[1]) for x in rows if trusted.get(x[0]))
    place = quality.KEPT_SHARE * (len(aside) - 1)
    threshold = aside[int(place)] + (place % 1) * (aside[min(int(place) + 1, len(aside) - 1)] - aside[int(place)])
    want = []
    for i, text, *_ in rows:
        n, chars, symbols, lines, repeats = rules(text)
        failed = n < 50 or 100 * repeats > 50 * n
        want.append((i, n, chars, symbols, lines, repeats, failed, not failed and score(text) >= threshold - 1e-9, score(text)))
    got = quality.quality(frame(spark, rows, clash), label_frame).collect()
    key = lambda x: (str(x[0]), x[1], x[2], x[3])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(g)[:8] == w[:8]
        assert g.score == pytest.approx(w[8], abs=1e-5)
    assert any(w[7] for w in want) and any(not w[7] and not w[6] for w in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.quality(empty(spark), none).count() == 0
    rows = awkward_rows()
    got = quality.quality(frame(spark, rows), none).collect()
    assert len(got) == len(rows) and all(r.score == 0 and r.kept == (not r.base_failed) for r in got)


def test_every_trusted_document_counts(spark):
    labels = spark.range(25_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality._trusted(labels).count() == 25_000


@pytest.mark.parametrize("n", [1, 2, 150, 201])
def test_threshold_is_the_exact_quantile(spark, n):
    rng = random.Random(n)
    scores = spark.createDataFrame([(rng.choice([rng.gauss(0, 2), 0.5]),) for _ in range(n)], "score double")
    for share in (0.0, 0.01, 0.37, 1.0):
        want = sorted(r.score for r in scores.collect())
        place = share * (n - 1)
        low = want[int(place)]
        assert quality._quantile(scores, share) == pytest.approx(low + (place % 1) * (want[min(int(place) + 1, n - 1)] - low), abs=1e-12)
    assert quality._quantile(scores.limit(0), 0.5) is None

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import mixing_lm, rawtext
from kinweave.session import materialize
from tests.llm.samples import awkward_rows, empty, frame, lowered, words


def fold(i, parts):
    return 1 if i is None else zlib.crc32(str(i).encode()) % parts


def test_windows_against_plain_python():
    texts = ["", "Ab", None, "é漢", "xyzxyzxyz"]
    data, offsets = rawtext.text_buffer(pa.array(texts, pa.string()))
    keys, cuts = mixing_lm.windows(data, offsets)
    want = []
    for t in texts:
        b = b"\xff" * 5 + lowered(t).encode() + b"\xff"
        want.append([int.from_bytes(b[i: i + 6], "big") for i in range(len(b) - 5)])
    assert [keys[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == want


def test_base_columns_equal_brute_force(spark):
    rows = awkward_rows()
    got = sorted(mixing_lm.score_texts(frame(spark, rows, True)).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    train = Counter()
    for i, text, *_ in rows:
        if fold(i, 10):
            train.update([w.encode() for w in words(lowered(text))] + [None])
    total, distinct = sum(train.values()), len(train)
    want = []
    for i, text, *_ in rows:
        tokens = [w.encode() for w in words(lowered(text))] + [None]
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        want.append((i, fold(i, 10) == 0, len(tokens), sum(train[t] > 0 for t in tokens), total, base))
    want.sort(key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g.score < 0 and g.bits_per_byte > 0
    assert mixing_lm.score_texts(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "text", (rawtext.crc_fold(F.col("doc_id"), 10) == 0).alias("held_out")
    )
    return rows, mixing_lm.fit(materialize(mixing_lm.corpus_counts(rows)))


def test_byte_probabilities_add_up_to_one(fitted):
    model = fitted[1]
    context = int.from_bytes(b"the o", "big") << 8
    keys = np.array([context + b for b in range(256)], np.uint64)
    assert (10 ** model.log10(keys)).sum() == pytest.approx(1)


def test_scores_are_sums_over_windows_and_beat_plain_counts(spark, fitted):
    rows, model = fitted
    got = mixing_lm.score_texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got[:5]:
        data, offsets = rawtext.text_buffer(pa.array([texts[r.doc_id]]))
        assert r.score == pytest.approx(model.log10(mixing_lm.windows(data, offsets)[0]).sum(), rel=1e-4)
    held = [r for r in got if r.held_out]
    seen = Counter(b"".join(lowered(texts[r.doc_id]).encode() for r in got if not r.held_out))
    n = sum(seen.values())
    plain = sum(-math.log2((seen[b] + 0.4) / (n + 102)) for r in held for b in lowered(texts[r.doc_id]).encode())
    size = sum(len(texts[r.doc_id].encode()) for r in held)
    mixed = sum(-r.score * math.log2(10) for r in held)
    assert held and mixed < 0.8 * plain, (mixed / size, plain / size)
    # better than the best single order with the same counts
    print("bits per byte", mixed / size, "order 0", plain / size, "words", sum(-r.base_score * math.log2(10) for r in held) / size)

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from kinweave.llm import langid, rawtext
from tests.llm.samples import awkward_rows, empty, frame


def plain_grams(text):
    raw = b" " + bytes(langid._PLAIN[b] for b in (text or "").encode()) + b" "
    return Counter(raw[i: i + n] for n in langid.LENGTHS for i in range(len(raw) - n + 1) if b"  " not in raw[i: i + n])


def test_subwords_against_plain_python():
    texts = ["Hello, wörld 42!", None, "", "a", "x  y", "漢字 a-b"]
    data, offsets = rawtext.text_buffer(pa.array(texts, pa.string()))
    buckets, rows = langid.subwords(data, offsets)
    alone = []
    for i, t in enumerate(texts):
        grams = plain_grams(t)
        own = Counter(buckets[rows == i].tolist())
        key = lambda g: int(rawtext.mix(np.array([int.from_bytes(g, "big") + (len(g) << 40)], np.uint64))[0] >> np.uint64(64 - langid.BUCKET_BITS))
        want = Counter()
        for g, n in grams.items():
            want[key(g)] += n
        assert own == want
        alone.append(want)
    assert sum(map(len, alone)) > 20


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.language_report(df).collect()}
    rows = df.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [(r.lang, got[r.doc_id]) for r in rows if got[r.doc_id].held_out]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out for i, r in got.items())
    assert sum(lang == r.lang_pred for lang, r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in got.values()) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_scores_are_calibrated():
    rng = np.random.default_rng(1)
    model = langid.Classifier(["a", "b"], np.zeros((1, 2)), np.zeros(2))
    truth = rng.random(4000)
    labels = (rng.random(4000) < truth).astype(int)
    raw = 7 * np.stack([np.zeros(4000), np.log(truth / (1 - truth))], axis=1)
    langid.calibrate(model, raw, labels)
    p = langid.softmax(raw / model.temperature)
    for low in (0.5, 0.6, 0.7, 0.8, 0.9):
        some = (p.max(axis=1) >= low) & (p.max(axis=1) < low + 0.1)
        assert abs((p.argmax(axis=1) == labels)[some].mean() - p.max(axis=1)[some].mean()) < 0.06


def test_awkward_rows(spark):
    rows = awkward_rows() + [(300, "123 !!! 456", "en", "a", 1), (301, "漢字", "en", "a", 1)]
    got = langid.language_report(frame(spark, rows, True)).collect()
    assert len(got) == len(rows)
    for (i, text), pred in zip(sorted(((r[0], r[1]) for r in rows), key=str), sorted(((r.doc_id, r.lang_pred) for r in got), key=str)):
        assert i == pred[0]
    by_id = {r.doc_id: r for r in got}
    assert by_id[300].lang_pred == by_id[60].lang_pred == by_id[61].lang_pred == "und" and by_id[300].score == 0 and by_id[300].rejected
    assert by_id[301].lang_pred in ("en", "de")
    assert langid.language_report(empty(spark)).count() == 0
    unlabelled = [(i, t, None, s, n) for i, t, _, s, n in rows]
    assert {r.lang_pred for r in langid.language_report(frame(spark, unlabelled)).collect()} == {"und"}
    kept = langid.accepted(frame(spark, rows, True))
    assert kept.columns == frame(spark, rows, True).columns and kept.filter("doc_id in (60, 61, 62, 300)").count() == 0


def test_repeated_rows_make_no_language_vanish(spark):
    """Three documents of a language, each thousands of times, beside two languages of many documents."""
    rng = np.random.default_rng(3)
    vocabulary = {"de": "der die und nicht eine schule haus garten", "en": "the and not school house garden of this", "fr": "les des une ecole maison jardin dans pas"}
    text = lambda lang: " ".join(rng.choice(vocabulary[lang].split(), 30))
    rows = [(i, text("de"), "de", "a", 1) for i in (1, 2, 4)] * 4000
    rows += [(i, text(lang), lang, "a", 1) for lang, first in (("en", 1000), ("fr", 2000)) for i in range(first, first + 300)]
    # one id with two texts counts once, whatever the order
    rows += [(1000, "zzz zzz", "en", "a", 1)]
    model = langid.fit(frame(spark, rows), per_language=50)
    assert model.languages == ["de", "en", "fr"]
    again = langid.fit(frame(spark, rows[::-1]), per_language=50)
    assert np.array_equal(model.logits, again.logits) and model.temperature == again.temperature
    got = {(r.lang, r.lang_pred) for r in langid.predict(frame(spark, rows[:3] + rows[-101:-1]), model).select("lang", "lang_pred").collect()}
    assert got == {("de", "de"), ("fr", "fr")}


def test_many_labels_are_joined(spark, monkeypatch):
    rows = awkward_rows()
    few = langid.fit(frame(spark, rows))
    monkeypatch.setattr(langid, "MAX_SENT_LABELS", 1)
    many = langid.fit(frame(spark, rows))
    assert few.languages == many.languages and len(few.languages) > 1 and np.array_equal(few.logits, many.logits)


def test_nothing_learned_rejects_no_language(spark):
    rows = [(i, t, None, s, n) for i, t, _, s, n in awkward_rows()]
    kept = langid.accepted(frame(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(str((i, t)) for i, t, *_ in rows if any(c.isalpha() for c in t or ""))

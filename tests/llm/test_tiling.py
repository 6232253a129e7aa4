import random
import re
import time

import numpy as np
import pyarrow as pa

from kinweave.llm import rawtext, tiling
from tests.llm.samples import awkward_rows, empty, frame


def plain_words(text):
    return [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]


def greedy(item, text, least=tiling.MIN_MATCH):
    """Greedy tiling by trying every pair of starts."""
    a, b, covered = [True] * len(item), [True] * len(text), 0
    for size in range(min(len(item), len(text)), least - 1, -1):
        for i in range(len(item) - size + 1):
            for j in range(len(text) - size + 1):
                if item[i:i + size] == text[j:j + size] and all(a[i:i + size]) and all(b[j:j + size]):
                    a[i:i + size] = [False] * size
                    b[j:j + size] = [False] * size
                    covered += size
    return covered


def test_tiles_equal_plain_greedy_tiling():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.randint(1, 4) for _ in range(rng.randint(4, 30))]
        text = [rng.randint(1, 4) for _ in range(rng.randint(1, 50))]
        if rng.random() < 0.5:
            cut = rng.randint(0, len(item))
            text += item[cut:] + item[:cut]
        found = tiling.tiles(np.array(item, np.uint64), np.array(text, np.uint64))
        assert sum(n for _, _, n in found) == greedy(item, text)
        assert all(item[i:i + n] == text[j:j + n] for i, j, n in found)


def planted(seed=2):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 50)))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "too short"), (93, items[0][1]), (None, " ".join(rng.choices(vocabulary, k=20)))]
    rows = awkward_rows()
    for i in range(400, 480):
        words = rng.choices(vocabulary, k=rng.randint(20, 150))
        own = rng.choice(items[:30])[1].split()
        kind = i % 5
        if kind == 0:
            words[5:5] = own
        elif kind == 1:
            cut = len(own) // 2
            words[5:5] = [w.upper() + "," for w in own[cut:]] + ["gap"] + own[:cut]
        elif kind == 2:
            words[5:5] = own[: len(own) // 3]
        elif kind == 3:
            words[5:5] = own[:6] + ["x"] + own[6:11] + ["y"] + own[11:]
        rows.append((i, " ".join(words), "en", "a", 1))
    return items, rows


def test_pairs_equal_tiling_of_all_pairs(spark, monkeypatch):
    items, rows = planted()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for item, text in items:
        own = plain_words(text)
        if len(own) < tiling.MIN_MATCH:
            continue
        grams = {tuple(own[k:k + 4]) for k in range(len(own) - 3)}
        for i, body, *_ in rows:
            words = plain_words(body)
            if not any(tuple(words[k:k + 4]) in grams for k in range(len(words) - 3)):
                continue
            covered = greedy(own, words)
            if covered >= tiling.THRESHOLD * len(own):
                want.add((i, item, len(own), covered))
    got = tiling.contamination(frame(spark, rows, True), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.item_words, r.covered_words) for r in got} == want
    assert len({w[0] for w in want}) > 40
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 200)
    again = tiling.contamination(frame(spark, rows), benchmark).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    kept = tiling.without_benchmark(frame(spark, rows, True), benchmark)
    leaked = {w[0] for w in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in leaked)
    assert kept.columns == frame(spark, rows, True).columns
    assert tiling.contamination(empty(spark), benchmark).count() == 0
    assert tiling.contamination(frame(spark, rows), benchmark.filter("false")).count() == 0


def test_word_ids_ignore_case_and_punctuation():
    data, offsets = rawtext.text_buffer(pa.array(["The cat, sat!", "the CAT sat", "The cät"]))
    ids, cuts = tiling.word_ids(data, offsets)
    assert np.array_equal(ids[cuts[0]:cuts[1]], ids[cuts[1]:cuts[2]]) and ids[cuts[2]] == ids[0] and ids[cuts[2] + 1] != ids[1]


def test_signs_and_case_of_any_script_hide_nothing():
    pairs = [
        ("he said “hello world again” now", "he said hello world again now"), ("one two—three four", "one two three four"),
        ("ÉCOLE Öl ΑΒΓ жук", "école öl αβγ ЖУК"), ("a\u00a0b\u2009c…d", "a b c d"), ("«un» ¿dos? „drei“ 5€", "un dos drei 5"),
        ("我说：“床前明月光”。", "我说床前明月光"), ("🙂x🙂", "x"), ("naïve", "NAÏVE"),
    ]
    for one, other in pairs:
        ids, cuts = tiling.text_words(pa.array([one, None, other, "", one]))
        assert np.array_equal(ids[cuts[0]:cuts[1]], ids[cuts[2]:cuts[3]]), (one, other)
        assert np.array_equal(ids[cuts[0]:cuts[1]], ids[cuts[4]:cuts[5]]) and cuts[1] == cuts[2] and cuts[3] == cuts[4]


def test_long_items_are_tiled_quickly():
    rng = np.random.default_rng(4)
    item = rng.integers(1, 1 << 60, 4000).astype(np.uint64)
    pieces = np.split(item, np.sort(rng.choice(np.arange(1, 4000), 80, replace=False)))
    for text, least in ((item, 4000), (np.concatenate([item[2000:], item[:2000]]), 4000), (np.concatenate(pieces[::-1]), 3700)):
        begun = time.process_time()
        assert sum(n for _, _, n in tiling.tiles(item, text)) >= least
        assert time.process_time() - begun < 2


def test_short_items_and_scripts_without_spaces_are_matched(spark, monkeypatch):
    items = [(1, "Omega seven"), (2, "床前明月光疑是地上霜"), (3, "ที่นี่มีแมว"), (4, "lambda"), (5, None), (6, "?!"), (7, "𠀀𠀁𠀂𠀃𠀄")]
    texts = ["It is omega, seven!", "omega and seven", "他说床前明月光，疑是地上霜。", "床前", "บอกว่าที่นี่มีแมวดำ", "a lambda", "omega", None, "seven lambdas", "x𠀀𠀁𠀂𠀃𠀄y"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    want = {(0, 1), (2, 2), (4, 3), (5, 4), (9, 7)}
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1_000_000, 8):
        monkeypatch.setattr(tiling, "BLOCK_WORDS", size)
        got = tiling.contamination(frame(spark, rows), benchmark).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.coverage >= 0.5 for r in got)
        left = tiling.without_benchmark(frame(spark, rows), benchmark).collect()
        assert {r.doc_id for r in left} == set(range(10)) - {d for d, _ in want}

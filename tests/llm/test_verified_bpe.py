import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinweave.llm import verified_bpe
from tests.llm.samples import awkward_rows, empty, frame

PATH = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as file:
        return verified_bpe.WordBpe(file.read())


def texts():
    rng = random.Random(3)
    odd = [
        "<|endoftext|>", "a<|startoftext|><|endoftext|>b <|ENDOFTEXT|> <|endoftext|", "İstanbul Σς é é ́x",
        "a b c\x1cd \x85e  ", "don't I'LL 'sx ''s x's123", "x" * 3000, "ab" * 500, "각 漢字かな 🙂👍🏽", "\x00\x01 a\x00b",
    ]
    letters = ["".join(rng.choices("aaabehlnorst'é <ß1!.-漢 ", k=rng.randint(1, 25))) for _ in range(4000)]
    wide = [chr(c) for c in [*range(32, 0x600), *range(0x2000, 0x2070), *range(0x300, 0x330)]]
    return odd + letters + ["".join(rng.choices(wide, k=rng.randint(1, 40))) for _ in range(1500)]


def test_ids_and_text_equal_the_library(spark, library):
    rows = awkward_rows() + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(texts())]
    want = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], ids, library.decode(ids, skip_special_tokens=False)))
    got = verified_bpe.encode_and_decode(frame(spark, rows, True), PATH, block_bytes=50_000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert verified_bpe.encode_and_decode(empty(spark), PATH).count() == 0


def test_digests(spark, library):
    rows = awkward_rows()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = verified_bpe.round_trip_report(frame(spark, rows), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_checked_pairs_are_those_that_merging_leaves(ours):
    table, rng = ours.table, random.Random(5)
    tokens = [t for t in range(len(table.rank)) if not ours.texts[ours.text_starts[t]: ours.text_starts[t] + ours.text_lengths[t]].tobytes().endswith(b"</w>")]
    left, right = np.array(rng.choices(tokens, k=3000)), np.array(rng.choices(range(49_000), k=3000))
    whole = [table.merged(table.spelled(t)) == [t] for t in range(2000)]
    assert sum(whole) > 1900
    apart = table.kept_apart(left, right)
    for a, b, kept in zip(left.tolist(), right.tolist(), apart.tolist()):
        if table.merged(table.spelled(a)) == [a] and table.merged(table.spelled(b)) == [b]:
            assert kept == (table.merged(table.spelled(a) + table.spelled(b)) == [a, b])


def test_equal_merges_take_the_leftmost_first():
    vocabulary = {t: i for i, t in enumerate(["a", "b", "a</w>", "b</w>", "aa", "aaaa", "aab", "aa</w>", "aab</w>"])}
    merges = [("a", "a"), ("aa", "aa"), ("aa", "b"), ("a", "a</w>"), ("aa", "b</w>")]
    table = verified_bpe.MergeTable(vocabulary, merges, "</w>")
    words = ["a" * n + "b" * m for n in range(12) for m in range(3) if n + m] + ["aba" * 4, "baab", "a" * 200, "a" * 201 + "b"]
    ids, offsets = table.encode(words)
    for i, word in enumerate(words):
        symbols = [vocabulary[c] for c in word[:-1]] + [vocabulary[word[-1] + "</w>"]]
        while True:
            found = [(table.pairs[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in table.pairs]
            if not found:
                break
            k = min(found)[1]
            symbols[k: k + 2] = [table.pairs[symbols[k], symbols[k + 1]][1]]
        assert ids[offsets[i]: offsets[i + 1]].tolist() == symbols == table.merged(
            [vocabulary[c] for c in word[:-1]] + [vocabulary[word[-1] + "</w>"]]
        )


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        verified_bpe.MergeTable({"a": 0, "aa": 1, "aaa": 2}, [("aa", "a"), ("a", "a")], "</w>")

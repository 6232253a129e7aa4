import numpy as np
import pyarrow as pa

from kinweave.llm import rawtext, trie_tokens
from tests.llm.samples import awkward_rows, empty, frame, words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_counts_equal_plain_recursion(spark):
    vocabulary = trie_tokens.Vocabulary(trie_tokens.load_pieces(MODEL))
    rows = awkward_rows() + [(200, "the quick internationalisation of tokenization, naïve ▁mark don't 1234", "en", "a", 1)]
    memo = {}

    def tokens(word):
        if word not in memo:
            memo[word] = trie_tokens.count_one(word.encode(), vocabulary)
        return memo[word]

    want = sorted(((r[0], len(words(r[1])), sum(map(tokens, words(r[1])))) for r in rows), key=str)
    got = sorted((tuple(r) for r in trie_tokens.token_counts(frame(spark, rows, True), MODEL, block_bytes=20_000).collect()), key=str)
    assert got == want
    assert trie_tokens.token_counts(empty(spark), MODEL).count() == 0


def test_common_words_are_one_token_and_scores_decide():
    pieces = {trie_tokens.symbols(p): s for p, s in (("▁", -1.0), ("▁ab", -3.0), ("a", -1.0), ("b", -1.0), ("abc", -1.5), ("c", -1.0))}
    vocabulary = trie_tokens.Vocabulary(pieces)
    texts = ["ab", "abc", "a", "abcabc", "z", "é"]
    data, offsets = rawtext.text_buffer(pa.array(texts))
    starts, ends, _ = rawtext.word_spans(data, offsets)
    # ab: mark a b = -3 ties with the whole piece, whose last piece is longer; abc: mark + abc = -2.5
    assert trie_tokens.trie_counts(data, starts, ends, vocabulary).tolist() == [3, 2, 2, 3, 2, 3]
    assert np.array_equal([trie_tokens.count_one(t.encode(), vocabulary) for t in texts], [3, 2, 2, 3, 2, 3])

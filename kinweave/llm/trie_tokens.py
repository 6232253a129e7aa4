"""Token counts by unigram segmentation, computed once per shared prefix of the distinct pre-tokens.

A pre-token is a word with the word mark in front. Its segmentation is the one of highest total score,
found by the forward recursion: the best score of a prefix is the best of a shorter prefix plus the score
of the piece between them. The distinct pre-tokens of a block go into a trie level by level; the recursion
runs once per trie node, for all nodes of a level at a time, and the node where a pre-token ends holds its
token count. Documents then add up the counts of their pre-tokens.

The public vocabularies are ordered, not weighted, so the score of a piece is the Zipf log probability of
its rank. A byte outside all pieces is a token of its own at BYTE_SCORE. Of equally good segmentations
the one whose last piece is shorter counts. Nothing is shuffled: a block is a few megabytes of text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rawtext import mix, row_sums, slices, span_hashes, text_buffer, word_spans

#: Symbol of the word mark; bytes are 0 to 255.
MARK = 256
BYTE_SCORE = -30.0
ZIPF_SHIFT = 2.7
#: Words of more bytes are segmented one by one instead of deepening the trie.
TRIE_DEPTH = 48
_STEP = 0x9E3779B97F4A7C15 | 1
_FILTER_BITS = 22


def load_pieces(path: str) -> dict[tuple[int, ...], float]:
    """Pieces of a sentencepiece model as symbol tuples, with their scores; under 1 MB, read by the driver."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        processor.id_to_piece(i) for i in range(processor.get_piece_size())
        if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))
    ]
    total = math.log(sum(1 / (rank + ZIPF_SHIFT) for rank in range(len(names))))
    return {symbols(name): -math.log(rank + ZIPF_SHIFT) - total for rank, name in enumerate(names)}


def symbols(piece: str) -> tuple[int, ...]:
    out: list[int] = []
    for part in piece:
        out += [MARK] if part == "▁" else part.encode()
    return tuple(out)


class Vocabulary:
    """Pieces by length: sorted hashes with scores, behind a bit filter."""

    def __init__(self, pieces: dict[tuple[int, ...], float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted(set(map(len, pieces))):
            own = [(self.path(p), s) for p, s in pieces.items() if len(p) == length]
            hashes = np.array([h for h, _ in own], np.uint64)
            scores = np.array([s for _, s in own])
            order = np.argsort(hashes)
            present = np.zeros(1 << _FILTER_BITS, bool)
            present[mix(hashes) >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[length] = hashes[order], scores[order], present
        self.powers = np.array([pow(_STEP, n, 1 << 64) for n in range(self.longest + 1)], np.uint64)

    @staticmethod
    def path(piece: tuple[int, ...]) -> int:
        value = 0
        for symbol in piece:
            value = (value * _STEP + int(SYMBOL_VALUES[symbol])) % (1 << 64)
        return value

    def scores(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the hashes that are pieces of this length."""
        if length not in self.by_length:
            return np.zeros(0, np.int64), np.zeros(0)
        known, scores, present = self.by_length[length]
        at = np.flatnonzero(present[mix(hashes) >> np.uint64(64 - _FILTER_BITS)])
        place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        hit = known[place] == hashes[at]
        return at[hit], scores[place[hit]]


SYMBOL_VALUES = np.random.default_rng(7).integers(1, 1 << 63, MARK + 1, dtype=np.uint64)


def count_one(word: bytes, vocabulary: Vocabulary) -> int:
    """Tokens of one pre-token by the plain recursion."""
    sequence = (MARK, *word)
    best, count = [0.0], [0]
    for end in range(1, len(sequence) + 1):
        top, tokens = best[end - 1] + BYTE_SCORE, count[end - 1] + 1
        for start in range(end - 1, max(-1, end - 1 - vocabulary.longest), -1):
            score = vocabulary.pieces.get(sequence[start:end])
            if score is not None and best[start] + score > top:
                top, tokens = best[start] + score, count[start] + 1
        best.append(top)
        count.append(tokens)
    return count[-1]


def trie_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Token counts of distinct words given as byte ranges."""
    out = np.zeros(len(starts), np.int64)
    long = ends - starts > TRIE_DEPTH
    raw = data.tobytes() if long.any() else b""
    for i in np.flatnonzero(long):
        out[i] = count_one(raw[starts[i]: ends[i]], vocabulary)
    alive = np.flatnonzero(~long)
    length = ends - starts
    node = np.zeros(len(alive), np.int64)
    # per level: hash of the path, best score, its tokens, and the node above
    levels = [(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    depth = 0
    while len(alive):
        if depth:
            byte = data[starts[alive] + depth - 1].astype(np.int64)
        else:
            byte = np.full(len(alive), MARK)
        edges, node = np.unique(node * (MARK + 1) + byte, return_inverse=True)
        above, symbol = edges // (MARK + 1), edges % (MARK + 1)
        path = levels[-1][0][above] * np.uint64(_STEP) + SYMBOL_VALUES[symbol]
        best, count = levels[-1][1][above] + BYTE_SCORE, levels[-1][2][above] + 1
        depth += 1
        start = above
        for size in range(1, min(depth, vocabulary.longest) + 1):
            upper = levels[depth - size]
            piece = path - upper[0][start] * vocabulary.powers[size]
            at, score = vocabulary.scores(size, piece)
            total = upper[1][start[at]] + score
            better = total > best[at]
            best[at[better]] = total[better]
            count[at[better]] = upper[2][start[at[better]]] + 1
            start = upper[3][start]
        levels.append((path, best, count, above))
        done = length[alive] == depth - 1
        out[alive[done]] = count[node[done]]
        alive, node = alive[~done], node[~done]
    return out


def token_counts(
    df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4_000_000
) -> DataFrame:
    """(id, n_words, n_tokens) for every row. Null and empty texts have none; null ids and repeats stay."""
    sent = df.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for part in slices(batches, "text", block_bytes):
            data, offsets = text_buffer(part.column("text"))
            starts, ends, cuts = word_spans(data, offsets)
            _, first, word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            tokens = trie_counts(data, starts[first], ends[first], vocabulary)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(cuts)), pa.array(row_sums(tokens[word], cuts))],
                ["id", "n_words", "n_tokens"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        count, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_tokens bigint"
    ).withColumnRenamed("id", id_col)

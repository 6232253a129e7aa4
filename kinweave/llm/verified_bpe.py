"""Byte-pair encoding with word ends, by guessing and checking, and decoding from the ids.

The encoder has a vocabulary with merges in order of rank, in which the last symbol of a pre-token carries the
word end. Pre-tokens are encoded in three steps:

1. Guess: from left to right, the longest token of the vocabulary (those only that stay whole under their own
   merges), by a trie of symbols. All new pre-tokens of a block walk the trie together.
2. Check: the guess is what the merges give exactly if every two neighbours are what the merges give for them
   alone. For a pair, the merges are undone from the latest on, on the left token's right edge and the right
   token's left edge; no merge across the border may come before the one undone last. All distinct pairs
   of a block are undone together.
3. Merge: only pre-tokens with a failing pair are merged one by one, from a heap of ranks and places.

A word between ASCII white space is normalised and cut on its own, since neither composition nor any pattern of
the tokenizer reaches across white space; special tokens in a word are cut out first, as the library
does. Words already met are kept in a table of bounded size. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rawtext import IS_WORD, slices, string_array, take_ranges, text_buffer, word_spans

BLOCK_BYTES = 2_000_000
#: Words and pre-tokens of which the ids are kept; longer ones are encoded each time.
KNOWN, KNOWN_LENGTH = 600_000, 64
#: Pre-tokens of more symbols walk the trie one by one.
LONG = 64
_NEVER = np.iinfo(np.int64).max


class MergeTable:
    """Vocabulary and merges as arrays: what each token is made of, when, and which pairs merge."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        size = max(vocabulary.values()) + 1
        self.word_end = word_end
        self.rank = np.full(size, -1)
        self.left, self.right = np.arange(size), np.arange(size)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            # the word end stands at the end only, so the left part has none
            whole, left, right = vocabulary[a + b], vocabulary[a], vocabulary[b]
            if self.rank[whole] >= 0:
                raise ValueError("a token has to come from one merge")
            self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
            self.pairs[left, right] = rank, whole
        made = np.flatnonzero(self.rank >= 0)
        if (np.maximum(self.rank[self.left[made]], self.rank[self.right[made]]) >= self.rank[made]).any():
            raise ValueError("merges have to come after those of their parts")
        self.size = size
        keys = np.array([a * size + b for a, b in self.pairs], np.int64)
        ranks = np.array([r for r, _ in self.pairs.values()], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = np.append(keys[order], _NEVER), np.append(ranks[order], _NEVER)
        self._symbols(vocabulary)
        whole = self.rank < 0
        alone = np.zeros(size, bool)
        alone[made] = self.kept_apart(self.left[made], self.right[made], self.rank[made])
        for token in made[np.argsort(self.rank[made])].tolist():
            whole[token] = alone[token] and whole[self.left[token]] and whole[self.right[token]]
        self._trie(whole)

    def _symbols(self, vocabulary: dict[str, int]) -> None:
        """Single characters, inside a word and at its end, by code point."""
        places = [(ord(t[0]), i) for t, i in vocabulary.items() if len(t) == 1]
        ends = [(ord(t[0]), i) for t, i in vocabulary.items() if t[1:] == self.word_end]
        top = max(c for c, _ in places + ends) + 1
        self.inner, self.last = np.full(top, -1), np.full(top, -1)
        for table, found in ((self.inner, places), (self.last, ends)):
            for character, token in found:
                table[character] = token

    def spelled(self, token: int) -> list[int]:
        """The symbols of a token."""
        if self.rank[token] < 0:
            return [token]
        return self.spelled(int(self.left[token])) + self.spelled(int(self.right[token]))

    def _trie(self, whole: np.ndarray) -> None:
        self.next: dict[tuple[int, int], int] = {}
        ends = [-1]
        for token in np.flatnonzero(whole).tolist():
            node = 0
            for symbol in self.spelled(token):
                node = self.next.setdefault((node, symbol), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = token
        self.token_at = np.array(ends)
        keys = np.array([node * self.size + symbol for node, symbol in self.next], np.int64)
        order = np.argsort(keys)
        self._steps = np.append(keys[order], _NEVER)
        self._nodes = np.append(np.array(list(self.next.values()), np.int64)[order], 0)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or _NEVER."""
        keys = left * self.size + right
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._ranks[at], _NEVER)

    def kept_apart(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether no merge of rank under ``limit`` crosses the border of the two tokens."""
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), limit) if np.isscalar(limit) else limit.copy()
        apart = np.ones(len(left), bool)
        open_ = np.arange(len(left))
        while len(open_):
            a, b = left[open_], right[open_]
            crossed = self.ranks(a, b) < limit[open_]
            apart[open_[crossed]] = False
            open_ = open_[~crossed & ((self.rank[a] >= 0) | (self.rank[b] >= 0))]
            a, b = left[open_], right[open_]
            undo = self.rank[a] > self.rank[b]
            # of equal merges the left one comes first: a later equal one inside the right token has not happened yet
            limit[open_] = np.where(undo, self.rank[a], self.rank[b] + 1)
            left[open_] = np.where(undo, self.right[a], a)
            right[open_] = np.where(undo, b, self.left[b])
        return apart

    def guess(self, symbols: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets) by longest match for the pre-tokens symbols[cuts[i]:cuts[i + 1]]."""
        ends = cuts[1:]
        short = np.flatnonzero(np.diff(cuts) <= LONG)
        owners, found = [], []
        alive, at = short, cuts[short]
        while len(alive):
            token, stop = np.full(len(alive), -1), at.copy()
            walking, node, here = np.arange(len(alive)), np.zeros(len(alive), np.int64), at.copy()
            while len(walking):
                key = node * self.size + symbols[here]
                place = np.searchsorted(self._steps, key)
                hit = self._steps[place] == key
                walking, node, here = walking[hit], self._nodes[place[hit]], here[hit] + 1
                whole = self.token_at[node]
                match = whole >= 0
                token[walking[match]], stop[walking[match]] = whole[match], here[match]
                inside = here < ends[alive[walking]]
                walking, node, here = walking[inside], node[inside], here[inside]
            owners.append(alive)
            found.append(token)
            going = stop < ends[alive]
            alive, at = alive[going], stop[going]
        for i in np.flatnonzero(np.diff(cuts) > LONG).tolist():
            tokens = self._guess_one(symbols[cuts[i]: cuts[i + 1]].tolist())
            owners.append(np.full(len(tokens), i))
            found.append(np.array(tokens))
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        tokens = (np.concatenate(found) if found else owner)[order]
        return tokens, np.searchsorted(owner[order], np.arange(len(cuts)))

    def _guess_one(self, symbols: list[int]) -> list[int]:
        tokens, at, ends = [], 0, self.token_at
        while at < len(symbols):
            node, here, token, stop = 0, at, -1, at
            while here < len(symbols):
                node = self.next.get((node, symbols[here]), 0)
                if not node:
                    break
                here += 1
                if ends[node] >= 0:
                    token, stop = int(ends[node]), here
            tokens.append(token)
            at = stop
        return tokens

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging of one pre-token: lowest rank first, of equal ones the leftmost."""
        n = len(symbols)
        token, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(token, token[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or token[i] != pair[0] or token[j] != pair[1]:
                continue
            token[i], token[j] = self.pairs[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (token[k], token[after[k]]) in self.pairs:
                    fresh = token[k], token[after[k]]
                    heapq.heappush(heap, (self.pairs[fresh][0], k, fresh))
        return [t for t in token if t >= 0]

    def encode(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pre-tokens in the byte-level alphabet."""
        points = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), np.uint32)
        cuts = np.zeros(len(pre_tokens) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens)), out=cuts[1:])
        symbols = self.inner[points]
        symbols[cuts[1:] - 1] = self.last[points[cuts[1:] - 1]]
        tokens, offsets = self.guess(symbols, cuts)
        border = np.ones(max(len(tokens) - 1, 0), bool)
        border[offsets[1:-1] - 1] = False
        border = np.flatnonzero(border)
        pairs, which = np.unique(tokens[border] * self.size + tokens[border + 1], return_inverse=True)
        failing = border[~self.kept_apart(pairs // self.size, pairs % self.size)[which]]
        if not len(failing):
            return tokens, offsets
        words = np.unique(np.searchsorted(offsets, failing, "right") - 1)
        lengths = np.diff(offsets)
        pool = [tokens]
        starts, at = offsets[:-1].copy(), len(tokens)
        for word in words.tolist():
            ids = self.merged(symbols[cuts[word]: cuts[word + 1]].tolist())
            pool.append(np.array(ids))
            starts[word], lengths[word] = at, len(ids)
            at += len(ids)
        return take_ranges(np.concatenate(pool), starts, lengths)


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        # only what this method rests on
        if spec["decoder"] is not None or spec["post_processor"] is not None or not model["end_of_word_suffix"]:
            raise ValueError("a tokenizer with word ends, without decoder and post-processor is expected")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens have to be cut from the raw text as they stand")
        library = Tokenizer.from_str(content)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = MergeTable(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        texts = [(" " + names.get(i, "")).encode() for i in range(max(names) + 1)]
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.text_lengths = np.array(list(map(len, texts)))
        self.text_starts = np.cumsum(self.text_lengths) - self.text_lengths
        self.known: dict[str, np.ndarray] = {}
        self.known_parts: dict[str | int, np.ndarray] = {}

    def parts(self, word: str) -> list[str | int]:
        """Pre-tokens of a word without white space, and ids of the special tokens in it."""
        for content, token in self.special.items():
            if content in word:
                head, _, tail = word.partition(content)
                return (self.parts(head) if head else []) + [token] + (self.parts(tail) if tail else [])
        return [name for name, _ in self.cut(self.normalise(word)) if name]

    def cut_words(self, words: list[str]) -> list[list[str | int]]:
        """``parts`` of many words: those without special tokens are cut together, a line each."""
        plain = [i for i, w in enumerate(words) if not any(s in w for s in self.special)]
        # an ASCII word is composed as it is
        lines = [words[i].lower() if words[i].isascii() else self.normalise(words[i]) for i in plain]
        ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
        cut = self.cut("\n".join(lines)) if lines else []
        line = np.searchsorted(ends, [place[0] for _, place in cut], "right")
        out: list[list[str | int]] = [[] for _ in words]
        for (name, _), i in zip(cut, line.tolist()):
            out[plain[i]].append(name)
        for i in set(range(len(words))).difference(plain):
            out[i] = self.parts(words[i])
        return out

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of distinct words."""
        if len(self.known) + len(self.known_parts) > KNOWN:
            self.known.clear()
            self.known_parts.clear()
        fresh = [w for w in words if w not in self.known]
        cut, parts = self.cut_words(fresh), self.known_parts
        new = list(dict.fromkeys(n for part in cut for n in part if n not in parts))
        names = [n for n in new if isinstance(n, str)]
        parts.update((n, np.array([n], np.int32)) for n in new if isinstance(n, int))
        if names:
            ids, offsets = self.table.encode(names)
            ids = ids.astype(np.int32)
            # copies, so that a kept piece does not keep the block
            parts.update((n, ids[a:b].copy()) for n, a, b in zip(names, offsets[:-1].tolist(), offsets[1:].tolist()))
        none = np.zeros(0, np.int32)
        found = {}
        for word, part in zip(fresh, cut):
            found[word] = parts[part[0]] if len(part) == 1 else np.concatenate([parts[n] for n in part]) if part else none
        out = [found[w] if w in found else self.known[w] for w in words]
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= KNOWN_LENGTH)
        for name in names:
            if len(name) > KNOWN_LENGTH:
                del parts[name]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts of a buffer."""
        starts, ends, cuts = word_spans(data, offsets)
        spans = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=spans[1:])
        found = string_array(data[IS_WORD[data]], spans).dictionary_encode()
        ids = self.words(found.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        word = found.indices.to_numpy()
        taken, ends = take_ranges(pool, (np.cumsum(lengths) - lengths)[word], lengths[word])
        return taken, ends[cuts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The names of the ids of each row, special ones too, joined by a space."""
        lengths = self.text_lengths[ids]
        data, ends = take_ranges(self.texts, self.text_starts[ids], lengths)
        # the space in front of a row's first name goes
        first = ends[offsets[:-1][np.diff(offsets) > 0]]
        kept = np.ones(len(data), bool)
        kept[first] = False
        ends = ends[offsets]
        return string_array(data[kept], ends - np.searchsorted(first, ends))


_loaded: dict[int, WordBpe] = {}


def _tokenizer(content: str) -> WordBpe:
    """One table for a worker, which lives on from task to task."""
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(content)
    return _loaded[key]


def encode_and_decode(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(id, ids, decoded) for every row: the token ids of the whole text, and the text they stand for.

    Null and empty texts have no ids and decode to an empty text; null ids and repeated rows stay. ``path`` is a
    tokenizer file of a megabyte or two, which the driver reads and sends to the tasks.
    """
    with open(path, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent.value)
        for part in slices(batches, "text", block_bytes):
            ids, offsets = tokenizer.encode(*text_buffer(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            decoded = tokenizer.decode(ids, offsets)
            yield pa.RecordBatch.from_arrays([part.column("id"), lists, decoded.cast(pa.string())], ["id", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string"
    ).withColumnRenamed("id", id_col)


def round_trip_report(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids, joined by spaces, and of the decoded text."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return encode_and_decode(df, path, id_col, text_col).select(
        id_col, F.size("ids").cast("bigint").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )

"""Language-model scores: logistic mixing of hashed byte contexts, bit by bit, in total bits per byte.

A text is its UTF-8 bytes in ASCII lower case and one end byte (0xFF, which no UTF-8 text holds). Each
byte is eight binary choices. Contexts of zero to five bytes are hashed, with the bits already known,
to slots that count zeros and ones over all training texts. The counts' logits are mixed with weights
that a gate picks by bit, order and how often the slot was seen; an adaptive probability map by bit and
seen count then corrects the mixed probability.

What a byte costs depends on its last six bytes alone, so the corpus is gathered as counts of distinct
six-byte windows (Spark aggregates them and the words in one pass). Slots are sums over windows; the
mixer learns online, in passes over the windows with their own occurrence taken out of the counts as in
prequential coding, each partition from the common weights, which are averaged after a pass. A document
costs the sum over its windows, and each distinct window is computed once per task.

Slot tables have 2**TABLE_BITS entries of four bytes whatever the corpus; word counts grow with it. Words
with a share of at least HEAVY of all tokens (1 / HEAVY of them at most) are sent to every task, the
others meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .rawtext import LOWER, crc_fold, mix, row_sums, slices, span_hashes, text_buffer, word_spans

TABLE_BITS = 22
ORDERS = 6
END = 0xFF
HEAVY = 1e-6
SEEN = 12
LEVELS = 33
ROUNDS = 3
#: Hash that stands for the end token.
END_TOKEN = np.int64(0x5BD1E995)
_FLUSH = 1_000_000
_SLICE = 1_000_000


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, cuts): the last six bytes at each byte and end of the rows, as 48-bit numbers."""
    n = len(offsets) - 1
    pad = ORDERS - 1
    padded = np.full(len(data) + pad * (n + 1), END, np.uint8)
    lengths = np.diff(offsets)
    starts = offsets[:-1] + pad * np.arange(1, n + 1)
    marks = np.zeros(len(padded) + 1, np.int8)
    full = lengths > 0
    marks[starts[full]] += 1
    marks[starts[full] + lengths[full]] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    padded[inside] = LOWER[data]
    inside[starts + lengths] = True
    keys = np.zeros(len(padded) - pad, np.uint64)
    for j in range(ORDERS):
        keys <<= np.uint64(8)
        keys |= padded[j: len(padded) - pad + j]
    return keys[inside[pad:]], np.concatenate([[0], np.cumsum(lengths + 1)])


def _slots(keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(order, bit, slots, values of the bit) for windows."""
    byte = keys & np.uint64(0xFF)
    for order in range(ORDERS):
        context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
        base = mix(context * np.uint64(8) + np.uint64(order + 1))
        for bit in range(8):
            known = (np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))) * np.uint64(0x9E3779B97F4A7C15)
            slots = ((base ^ known) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)
            yield order, bit, slots.view(np.int64), ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


class _Counter:
    """Counts of keys, handed on when there are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([x for x, _ in self.parts])
        counts = np.concatenate([x for _, x in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        merged = (keys[first], np.add.reduceat(counts, first) if len(first) else counts)
        self.parts, self.size = [merged], len(first)
        return merged

    def full(self) -> bool:
        if self.size > _FLUSH:
            self.merge()
        return self.size > _FLUSH // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        merged = self.merge() if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return merged


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(word, key, n): counts of words (by hash, with the end token) and of windows in the training rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {True: _Counter(), False: _Counter()}

        def rows_of(kind):
            keys, n = kinds[kind].take()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind)), pa.array(keys), pa.array(n)], ["word", "key", "n"]
            )

        for part in slices(batches, "text", _SLICE):
            data, offsets = text_buffer(part.column("text"))
            starts, ends, _ = word_spans(data, offsets)
            hashes = span_hashes(LOWER[data], starts, ends).view(np.int64)
            kinds[True].add(*np.unique(hashes, return_counts=True))
            kinds[True].add(np.array([END_TOKEN]), np.array([part.num_rows]))
            keys, _ = windows(data, offsets)
            kinds[False].add(*np.unique(keys.view(np.int64), return_counts=True))
            for kind in kinds:
                if kinds[kind].full():
                    yield rows_of(kind)
        for kind in kinds:
            yield rows_of(kind)

    counted = rows.filter("not held_out").select("text").mapInArrow(count, "word boolean, key bigint, n bigint")
    # mixed up, but in the same order on every run: the mixer learns in this order
    return counted.groupBy("word", "key").agg(F.sum("n").alias("n")).sortWithinPartitions(F.xxhash64("key"))


def _slot_tables(counts: DataFrame) -> np.ndarray:
    """Zeros and ones of each slot, halved together beyond 16 bits: (2, 2**TABLE_BITS) uint16."""
    size = 1 << TABLE_BITS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            n = batch.column("n").to_numpy()
            for at in range(0, len(keys), 1 << 17):
                part, weight = keys[at: at + (1 << 17)], n[at: at + (1 << 17)]
                for _, _, slots, bits in _slots(part):
                    np.add.at(total, (bits, slots), weight)
        used = np.flatnonzero(total.any(axis=0))
        for at in range(0, len(used), 1 << 18):
            slots = used[at: at + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots.astype(np.int32)), pa.array(total[0, slots]), pa.array(total[1, slots])], ["slot", "n0", "n1"]
            )

    def pack(key, group):
        slots = group["slot"].to_numpy() & 0x3FFF
        out = np.zeros((2, 1 << 14), "<u2")
        out[0, slots], out[1, slots] = group["n0"].to_numpy(), group["n1"].to_numpy()
        import pandas as pd

        return pd.DataFrame({"chunk": [key[0]], "counts": [out.tobytes()]})

    windows_only = counts.filter("not word").select("key", "n")
    summed = windows_only.mapInArrow(spread, "slot int, n0 bigint, n1 bigint").groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    scale = F.greatest(F.greatest("n0", "n1") / F.lit(65535.0), F.lit(1.0))
    short = summed.select(
        F.shiftright("slot", 14).alias("chunk"), "slot",
        F.ceil(F.col("n0") / scale).cast("int").alias("n0"), F.ceil(F.col("n1") / scale).cast("int").alias("n1"),
    )
    table = np.zeros((2, size), np.uint16)
    for row in short.groupBy("chunk").applyInPandas(pack, "chunk int, counts binary").collect():
        table[:, row.chunk << 14: (row.chunk + 1) << 14] = np.frombuffer(row.counts, "<u2").reshape(2, -1)
    return table


def _inputs(table: np.ndarray, keys: np.ndarray, without_own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, seen, bits) of shape (order, bit, window), (order, bit, window) and (bit, window)."""
    logits = np.empty((ORDERS, 8, len(keys)), np.float32)
    seen = np.empty((ORDERS, 8, len(keys)), np.int8)
    bits = np.empty((8, len(keys)), np.int8)
    for order, bit, slots, values in _slots(keys):
        n0, n1 = table[0, slots].astype(np.float32), table[1, slots].astype(np.float32)
        if without_own:
            n0, n1 = np.maximum(n0 - (1 - values), 0), np.maximum(n1 - values, 0)
        logits[order, bit] = np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))
        seen[order, bit] = np.minimum(np.log2(n0 + n1 + 1), SEEN - 1)
        bits[bit] = values
    return logits, seen, bits


def _gates(seen: np.ndarray) -> np.ndarray:
    """Index of the weight that each input gets."""
    orders = np.arange(ORDERS, dtype=np.int32)[:, None, None]
    bits = np.arange(8, dtype=np.int32)[None, :, None]
    return (orders * 8 + bits) * SEEN + seen


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _levels(mixed: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, part of the next cell) of the probability map: by bit, how often order three was seen, logit."""
    place = np.clip(mixed + 8, 0, 16) * ((LEVELS - 1) / 16)
    low = np.minimum(place.astype(np.int64), LEVELS - 2)
    bits = np.arange(8)[:, None]
    return (bits * SEEN + seen[3]) * LEVELS + low, place - low


class Model:
    """Slot counts, mixing weights and the probability map."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.weights = np.full(ORDERS * 8 * SEEN, 0.3)
        self.map = None

    def mixed(self, logits: np.ndarray, gates: np.ndarray) -> np.ndarray:
        return (self.weights[gates] * logits).sum(axis=0)

    def learn(self, keys: np.ndarray, counts: np.ndarray, squares: np.ndarray, rate: float = 0.05) -> None:
        """One online step on a block of windows (adaptive step sizes per weight)."""
        logits, seen, bits = _inputs(self.table, keys, True)
        gates = _gates(seen)
        error = (_squash(self.mixed(logits, gates)) - bits) * (counts / counts.sum())
        slope = np.bincount(gates.ravel(), (logits * error).ravel(), len(self.weights))
        squares += slope * slope
        self.weights = self.weights - rate * slope / np.sqrt(squares + 1e-12)

    def correction(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ones and all, by cell of the probability map."""
        logits, seen, bits = _inputs(self.table, keys, True)
        cell, part = _levels(self.mixed(logits, _gates(seen)), seen)
        size = 8 * SEEN * LEVELS
        out = np.zeros((2, size))
        for at, share in ((cell, 1 - part), (cell + 1, part)):
            weight = share * counts
            out[0] += np.bincount(at.ravel(), (weight * bits).ravel(), size)
            out[1] += np.bincount(at.ravel(), weight.ravel(), size)
        return out

    def bit_probabilities(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one, the bit) of shape (8, windows)."""
        logits, seen, bits = _inputs(self.table, keys, False)
        mixed = self.mixed(logits, _gates(seen))
        if self.map is not None:
            cell, part = _levels(mixed, seen)
            refined = self.map[cell] * (1 - part) + self.map[cell + 1] * part
            mixed = (mixed + refined) / 2
        return _squash(mixed), bits

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window, given the five before."""
        out = np.empty(len(keys))
        for at in range(0, len(keys), 1 << 14):
            ones, bits = self.bit_probabilities(keys[at: at + (1 << 14)])
            out[at: at + (1 << 14)] = np.log10(np.where(bits == 1, ones, 1 - ones)).sum(axis=0)
        return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        keys, n = batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        for at in range(0, len(keys), size):
            yield keys[at: at + size], n[at: at + size]


def fit(counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of a table of counts. Weights and map are small sums by index that Spark aggregates."""
    context = counts.sparkSession.sparkContext
    model = Model(_slot_tables(counts))
    rows = counts.filter("not word").select("key", "n")

    def summed(function) -> np.ndarray:
        """(index, a, b) rows of all tasks, summed by index."""
        sent = context.broadcast(model)

        def run(batches):
            a, b = function(sent.value, batches)
            at = np.flatnonzero(b)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(a[at]), pa.array(b[at])], ["at", "a", "b"])

        out = rows.mapInArrow(run, "at bigint, a double, b double").groupBy("at").agg(F.sum("a"), F.sum("b")).collect()
        sent.unpersist()
        return out

    def learned(start, batches):
        own, squares, total = Model(start.table), np.zeros(len(start.weights)), 0.0
        own.weights = start.weights
        for keys, n in _blocks(batches):
            own.learn(keys, n, squares)
            total += float(n.sum())
        return own.weights * total, np.full(len(own.weights), total)

    def corrected(start, batches):
        return sum((start.correction(*block) for block in _blocks(batches)), np.zeros((2, 8 * SEEN * LEVELS)))

    for _ in range(rounds):
        weights = model.weights.copy()
        for at, a, b in summed(learned):
            weights[at] = a / b
        model.weights = weights
    logit = np.tile(np.linspace(-8, 8, LEVELS), 8 * SEEN)
    ones, both = 20 * _squash(logit), np.full(len(logit), 20.0)
    for at, a, b in summed(corrected):
        ones[at] += a
        both[at] += b
    model.map = np.log((ones + 0.01) / (both - ones + 0.01))
    return model


class _Memo:
    """Costs of windows already met in this task: a direct-mapped table."""

    def __init__(self, model: Model, bits: int = 20):
        self.model, self.shift = model, np.uint64(64 - bits)
        self.keys, self.costs = np.full(1 << bits, np.uint64(2**64 - 1)), np.zeros(1 << bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)
        out = self.costs[at]
        missed = np.flatnonzero(self.keys[at] != keys)
        if len(missed):
            new, place = np.unique(keys[missed], return_inverse=True)
            costs = self.model.log10(new)
            out[missed] = costs[place]
            at = ((new * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)
            self.keys[at], self.costs[at] = new, costs
        return out


def _score_rows(rows: DataFrame, model: Model, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: bytes, tokens, the model's log10 probability, the heavy words' share and the other words."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast((model, *heavy))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, logs = sent.value
        memo = _Memo(model)
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text", _SLICE):
            data, offsets = text_buffer(part.column("text"))
            keys, cuts = windows(data, offsets)
            costs = row_sums(memo(keys), cuts)
            starts, ends, at = word_spans(data, offsets)
            hashes = span_hashes(LOWER[data], starts, ends).view(np.int64)
            place = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
            known = words[place] == hashes if len(words) else np.zeros(len(hashes), bool)
            n_known = row_sums(known.astype(np.int64), at)
            log_sum = row_sums(np.where(known, logs[place], 0.0) if len(words) else np.zeros(len(hashes)), at)
            others = np.concatenate([[0], np.cumsum(~known)])[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + part.num_rows)), part.column("id"), part.column("held_out"),
                 pa.array(np.diff(offsets)), pa.array(np.diff(at) + 1), pa.array(n_known), pa.array(log_sum),
                 pa.array(costs), pa.ListArray.from_arrays(pa.array(others), pa.array(hashes[~known]))],
                ["row", "id", "held_out", "n_bytes", "n_tokens", "n_known", "log_sum", "score", "others"],
            )
            row += part.num_rows

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "held_out").mapInArrow(
        score, f"row bigint, id {kind}, held_out boolean, n_bytes bigint, n_tokens bigint, n_known bigint, "
               "log_sum double, score double, others array<bigint>"
    )


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row per row of ``df``: token counts, base_score, score (both log10) and bits per byte.

    Rows whose crc32 of the id modulo ``folds`` is 0 are held out of all learning; a null id is learned
    from. A null text is an empty one: its only token and byte is the end. Repeated rows count each. An
    empty table gives an empty result.
    """
    rows = df.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (crc_fold(F.col(id_col), folds) == 0).alias("held_out")
    )
    counts = materialize(corpus_counts(rows))
    words = counts.filter("word").select("key", F.col("n").alias("c"))
    n, v, ends = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("key") == int(END_TOKEN), F.col("c"))), F.lit(0))
    ).first()
    frequent = words.filter(F.col("c") >= HEAVY * n).toPandas().sort_values("key")
    heavy = frequent["key"].to_numpy(np.int64), np.log10(frequent["c"].to_numpy(float) + 0.1)
    scored = materialize(_score_rows(rows, fit(counts), heavy))
    rare = scored.select("row", F.explode("others").alias("key")).join(words, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("rare_known"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rare_sum"),
    )
    end_log = F.log10(F.lit(float(ends)) + F.lit(0.1))
    total_log = F.log10(F.lit(n + 0.1 * (v + 1)))
    return scored.drop("others").join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0)) + end_log - F.col("n_tokens") * total_log).alias("base_score"),
        "score",
        (-F.col("score") * F.log2(F.lit(10.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )

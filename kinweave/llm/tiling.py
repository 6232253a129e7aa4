"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, marks and digits of any script in lower case, so punctuation, signs, spaces of any kind
and case hide nothing; in scripts written without spaces each character is a word. A benchmark item and a document that share a seed of MIN_MATCH words are tiled: the longest
common run of unmarked words is found by Karp-Rabin hashes, marked in both, and so on down to MIN_MATCH,
which also catches passages in another order. The item's share of marked words is its coverage; at
THRESHOLD or more the document leaks the item. An item of fewer than MIN_MATCH words leaks where a document
has it whole.

The benchmark is the stated query set: its words are hashed and its blocks of about BLOCK_WORDS words numbered
in a Spark job; the blocks are then read one at a time, each
sent to the tasks, and every document meets every block once, without a shuffle. Seeds of a block are a
bit table in front of a sorted list; only documents with seeds that could cover THRESHOLD of an item are
tiled, so the tiling never decides less than it would on all pairs.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .rawtext import mix, slices, span_hashes, text_buffer, word_spans

MIN_MATCH = 4
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
#: Code points of scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Kana and Han.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_FILTER_BITS = 22
_SLICE = 1_000_000

_PLAIN = np.full(256, ord(" "), np.uint8)
for _byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _PLAIN[_byte] = _byte
for _byte in range(ord("A"), ord("Z") + 1):
    _PLAIN[_byte] = _byte + 32
_PLAIN[0x80:] = np.arange(0x80, 256)


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts) of the words of each text, in lower case of any script."""
    return word_ids(*text_buffer(pc.utf8_lower(column)))


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts) of the words of each row."""
    plain = _without_signs(_PLAIN[data])
    starts, ends, cuts = word_spans(plain, offsets)
    inner = _character_borders(plain)
    if len(inner) and len(starts):
        word = np.maximum(np.searchsorted(starts, inner, "right") - 1, 0)
        inner = inner[(inner > starts[word]) & (inner < ends[word])]
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        cuts = np.searchsorted(starts, offsets)
    return span_hashes(plain, starts, ends), cuts


@functools.cache
def _is_sign() -> np.ndarray:
    """For each code point whether it is punctuation, a symbol, a space or a control, by its Unicode category."""
    return np.array([unicodedata.category(chr(point))[0] in "PSZC" for point in range(0x110000)])


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bytes, code point) of the characters of UTF-8 bytes that are not ASCII."""
    lead = np.flatnonzero(data >= 0xC0)
    size = np.where(data[lead] < 0xE0, 2, np.where(data[lead] < 0xF0, 3, 4))
    point = data[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | data[lead[more] + k] & 63
    return lead, size, point


def _without_signs(data: np.ndarray) -> np.ndarray:
    """The bytes with spaces in place of every sign that is not ASCII."""
    lead, size, point = _code_points(data)
    if len(lead):
        own = _is_sign()[point]
        lead, size = lead[own], size[own]
        for k in range(4):
            data[lead[size > k] + k] = ord(" ")
    return data


def _character_borders(data: np.ndarray) -> np.ndarray:
    """Starts and ends of the characters of UNSPACED scripts in UTF-8 bytes."""
    lead, size, point = _code_points(data)
    own = np.zeros(len(lead), bool)
    for low, high in UNSPACED:
        own |= (point >= low) & (point <= high)
    return np.unique(np.concatenate([lead[own], lead[own] + size[own]]))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words, from one rolling sum."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    powers = np.full(len(ids), base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * powers[::-1])])
    # run i has weight base ** (len - size - i) too much; runs are brought to the weight of the first
    return (sums[size:] - sums[:-size]) * powers[: len(ids) - size + 1]


def seeds_of(ids: np.ndarray, size: int = MIN_MATCH) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(len(ids) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + ids[j: j + n]
    return mix(out)


def tiles(item: np.ndarray, text: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words): greedily the longest unmarked common run, MIN_MATCH at least.

    Of equally long runs the first in the item, then in the text, is taken. Only lengths of which an unmarked common run
    is left are looked at, found by bisection: where one of some length is, one of each shorter length is.
    """
    found: list[tuple[int, int, int]] = []
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    size = min(len(item), len(text), longest or len(item))
    while size >= MIN_MATCH and _common(item, text, free_item, free_text, MIN_MATCH):
        low, high = MIN_MATCH, size
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if _common(item, text, free_item, free_text, middle) else (low, middle - 1)
        size = low
        own, other = _free_runs(item, free_item, size, len(text)), _free_runs(text, free_text, size, len(item))
        places = defaultdict(list)
        for at, key in zip(*(x[np.isin(other[1], own[1])].tolist() for x in other)):
            places[key].append(at)
        for at, key in zip(*(x[np.isin(own[1], other[1])].tolist() for x in own)):
            if not free_item[at: at + size].all():
                continue
            for to in places[key]:
                if free_text[to: to + size].all() and np.array_equal(item[at: at + size], text[to: to + size]):
                    free_item[at: at + size] = False
                    free_text[to: to + size] = False
                    found.append((at, to, size))
                    break
        size -= 1
    return found


def _free_runs(ids: np.ndarray, free: np.ndarray, size: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the runs of ``size`` words none of which is marked; hashes to be met with ``other`` words."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(marked[size:] == marked[:-size])
    return at, (window_hashes(ids, size) * _rescale(len(ids), other)[0])[at]


def _common(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, size: int) -> bool:
    """Whether an unmarked run of ``size`` words is in both."""
    own = _free_runs(item, free_item, size, len(text))[1]
    return bool(len(own)) and bool(np.isin(own, _free_runs(text, free_text, size, len(item))[1]).any())


def _rescale(a: int, b: int) -> tuple[np.uint64, np.uint64]:
    """Factors that bring the hashes of sequences of these lengths to a common weight."""
    base, longest = 0x9E3779B97F4A7C15, max(a, b)
    return np.uint64(pow(base, longest - a, 1 << 64)), np.uint64(pow(base, longest - b, 1 << 64))


class Block:
    """Items of the benchmark with their seeds."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items = items
        seeds = [seeds_of(ids) for _, ids in items]
        self.seeds = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        self.at = np.concatenate([*[np.arange(len(s)) for s in seeds], np.zeros(0, np.int64)])
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.item, self.at = self.seeds[order], self.item[order], self.at[order]
        self.present = np.zeros(1 << _FILTER_BITS, bool)
        self.present[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True
        #: items too short for a seed by their size: (hashes in order, item)
        self.short = {}
        for size in range(1, MIN_MATCH):
            own = np.array([i for i, (_, ids) in enumerate(items) if len(ids) == size], np.int64)
            if len(own):
                whole = np.concatenate([seeds_of(items[i][1], size) for i in own])
                order = np.argsort(whole, kind="stable")
                self.short[size] = whole[order], own[order]

    def whole_short(self, ids: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, words, 1) of the rows that have an item of fewer than MIN_MATCH words whole."""
        out = []
        for size, (own, item) in self.short.items():
            seeds = seeds_of(ids, size)
            hit = np.flatnonzero(np.isin(seeds, own))
            row = np.searchsorted(cuts, hit, "right") - 1
            whole = hit + size <= cuts[row + 1]
            low, high = (np.searchsorted(own, seeds[hit[whole]], side) for side in ("left", "right"))
            met = {(r, int(item[k])) for r, x, y in zip(row[whole].tolist(), low.tolist(), high.tolist()) for k in range(x, y)}
            out += [(r, i, size, 1) for r, i in sorted(met)]
        return out

    def leaks(self, ids: np.ndarray, cuts: np.ndarray, threshold: float) -> list[tuple[int, int, int, int]]:
        """(row, item, covered words, tiles) of the rows that reach the threshold."""
        seeds = seeds_of(ids)
        hit = np.flatnonzero(self.present[seeds >> np.uint64(64 - _FILTER_BITS)])
        row = np.searchsorted(cuts, hit, "right") - 1
        whole = hit + MIN_MATCH <= cuts[row + 1]
        hit, row = hit[whole], row[whole]
        low, high = np.searchsorted(self.seeds, seeds[hit]), np.searchsorted(self.seeds, seeds[hit], "right")
        hit, row, low, high = (x[high > low] for x in (hit, row, low, high))
        out = self.whole_short(ids, cuts)
        borders = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else [0]
        for a, b in zip(borders[:-1], borders[1:]):
            met = defaultdict(list)
            for position, x, y in zip(hit[a:b].tolist(), low[a:b].tolist(), high[a:b].tolist()):
                for k in range(x, y):
                    met[int(self.item[k])].append((int(self.at[k]), position))
            for item, pairs in met.items():
                if result := self._tile(item, pairs, ids, int(cuts[row[a]]), int(cuts[row[a] + 1]), threshold):
                    out.append((int(row[a]), item, *result))
        return out

    def _tile(self, item, pairs, ids, first, last, threshold):
        own = self.items[item][1]
        reach = np.zeros(len(own) + 1, bool)
        for at, _ in set(pairs):
            reach[at: at + MIN_MATCH] = True
        if reach.sum() < threshold * len(own):
            return None
        # words that no seed of this item touches can be in no tile; runs are kept apart by one such word
        positions = np.unique([p for _, p in pairs])
        touched = np.unique((positions[:, None] + np.arange(MIN_MATCH)).ravel())
        breaks = np.flatnonzero(np.diff(touched) > 1) + 1
        text = np.insert(ids[touched], breaks, np.uint64(0))
        runs = set(pairs)
        longest = max(_run(runs, p) for p in runs if (p[0] - 1, p[1] - 1) not in runs) + MIN_MATCH - 1
        found = tiles(own, text, longest)
        covered = sum(n for _, _, n in found)
        return (covered, len(found)) if covered >= threshold * len(own) else None


def _run(pairs: set[tuple[int, int]], start: tuple[int, int]) -> int:
    n, (a, b) = 1, start
    while (a + n, b + n) in pairs:
        n += 1
    return n


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, words, part, place): an item's hashed words, the task, and the words of the task's items before it."""
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in slices(iter([batch]), "t", _SLICE):
            ids, cuts = text_words(piece.column("t"))
            n = piece.num_rows
            words = [ids[lo:hi].astype("<u8").tobytes() for lo, hi in zip(cuts, cuts[1:])]
            place = done + cuts[:-1] - cuts[0]
            done += int(cuts[-1] - cuts[0])
            yield pa.RecordBatch.from_arrays(
                [piece.column("i"), pa.array(words, pa.binary()), pa.array(np.full(n, part, np.int32)), pa.array(place.astype(np.int64))],
                ["i", "words", "part", "place"],
            )


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The items in blocks, one read at a time; null texts and those without words cover nothing."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    items = materialize(rows.mapInArrow(_item_rows, f"i {kind}, words binary, part int, place bigint").filter("length(words) > 0"))
    ends = items.groupBy("part").agg(F.max(F.col("place") + F.expr("length(words) div 8")).alias("n")).orderBy("part").collect()
    starts, before = {}, 0
    for r in ends:
        starts[r.part], before = before, before + r.n
    if not starts:
        return
    at = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("part"))
    number = ((at + F.col("place")) / BLOCK_WORDS).cast("bigint")
    for k in range(-(-before // BLOCK_WORDS)):
        own = items.filter(number == k).orderBy("part", "place").select("i", "words").collect()
        if own:
            yield Block([(r.i, np.frombuffer(r.words, "<u8")) for r in own])


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, item_id, item_words, covered_words, coverage, tiles): pairs at the threshold, for every row.

    Null and empty texts leak nothing; repeated rows and items each have their pairs; null ids stay null.
    """
    spark = df.sparkSession
    id_kind = df.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType
    schema = f"{id_col} {id_kind}, item_id {item_kind.simpleString()}, item_words int, covered_words int, coverage double, tiles int"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for number, block in enumerate(blocks(benchmark)):
        sent = spark.sparkContext.broadcast(block)

        def scan(batches, sent=sent):
            block = sent.value
            for part in slices(batches, "text", _SLICE):
                found = block.leaks(*text_words(part.column("text")), threshold)
                at = pa.array([f[0] for f in found], pa.int64())
                items = [block.items[f[1]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), pa.array([i for i, _ in items], _arrow(item_kind)),
                     pa.array([len(w) for _, w in items], pa.int32()), pa.array([f[2] for f in found], pa.int32()),
                     pa.array([f[2] / len(w) for f, (_, w) in zip(found, items)], pa.float64()),
                     pa.array([f[3] for f in found], pa.int32())],
                    [id_col, "item_id", "item_words", "covered_words", "coverage", "tiles"],
                )

        own = rows.mapInArrow(scan, schema)
        # one block is one scan; of several each is written, so the plan does not grow with the benchmark
        out = own if number == 0 else materialize(out).unionByName(materialize(own))
    return out


def without_benchmark(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``df`` that leak no item."""
    for number, block in enumerate(blocks(benchmark)):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def keep(batches, sent=sent):
            for part in slices(batches, text_col, _SLICE):
                clean = np.ones(part.num_rows, bool)
                clean[[f[0] for f in sent.value.leaks(*text_words(part.column(text_col)), threshold)]] = False
                yield part.filter(pa.array(clean))

        df = (materialize(df) if number else df).mapInArrow(keep, df.schema)
    return df


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

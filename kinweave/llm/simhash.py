"""SimHash near-duplicates: 64-bit fingerprints linked at four or fewer differing bits.

Deletion-variant signatures: of three segments one differs by at most one bit when four bits differ in
all, so two linked fingerprints share a variant of that segment with one bit left out. Each distinct
fingerprint is indexed under its 64 variants; equal variants meet in one exchange, are verified bit by
bit, and each variant's fingerprints hand on a spanning forest of their links, never all pairs. Copies
share a fingerprint, so a group of copies is one entry of the index however large it is.

Fingerprints that crowd under one variant are met inside the task by three segments of the bits in which they
vary: linked ones have one of these alike, or alike but for one bit. So what is compared grows with
the fingerprints and not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import component_labels
from ..session import materialize
from .rawtext import LOWER, slices, text_buffer, word_spans

#: Segment borders: bits 0-20, 21-41 and 42-63.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 4
SHINGLE, SEED = 4, 42
#: Fingerprints of one key that are compared with one another; more are met by segments of their other bits.
DIRECT = 2048
#: With this few bits that vary there are too few different fingerprints to crowd.
FEW_BITS = 12
_COMPARED = 1 << 20


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints of the rows of a text buffer: majority bits of their shingles' XXH64."""
    from xxhash import xxh64_intdigest

    starts, ends, cuts = word_spans(data, offsets)
    n_words = np.diff(cuts)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    # words of all rows, each followed by one space
    lengths = ends - starts
    to = np.concatenate([[0], np.cumsum(lengths + 1)])
    keep = np.zeros(len(data) + 1, bool)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    keep[:-1] = np.cumsum(inside)[:-1] > 0
    plain = np.full(to[-1], ord(" "), np.uint8)
    place = np.ones(to[-1], bool)
    place[to[1:] - 1] = False
    plain[place] = LOWER[data[keep[:-1]]]
    text = plain.tobytes()
    first = np.repeat(cuts[:-1], n_shingles) + _within(n_shingles)
    last = first + np.repeat(np.minimum(n_words, shingle), n_shingles) - 1
    begin, stop = to[first].tolist(), (to[last] + lengths[last]).tolist() if len(first) else []
    hashes = np.fromiter((xxh64_intdigest(text[a:b], SEED) for a, b in zip(begin, stop)), np.uint64, len(begin))
    out = np.zeros(len(n_words), np.uint64)
    rows = np.flatnonzero(n_shingles)
    if len(rows):
        at = np.concatenate([[0], np.cumsum(n_shingles[rows])])
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for lo in range(0, len(rows), 4096):
            hi = min(lo + 4096, len(rows))
            bits = np.unpackbits(
                hashes[at[lo]: at[hi]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
            )
            counts = np.add.reduceat(bits, at[lo:hi] - at[lo], axis=0, dtype=np.int32)
            majority = 2 * counts > n_shingles[rows[lo:hi], None]
            out[rows[lo:hi]] = (majority * weights).sum(axis=1, dtype=np.uint64)
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... restarted for each count."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(starts, counts)


def fingerprint_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) for each row; null and empty texts have fingerprint zero."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            prints = fingerprints(*text_buffer(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints.view(np.int64))], ["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(add, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp): number of the left-out bit and the segment without it."""
    bit = F.col("bit")
    segment = F.lit(None).cast("bigint")
    for start, width in SEGMENTS:
        value = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        cleared = value.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, bit - {start})")))
        segment = F.when((bit >= start) & (bit < start + width), cleared).otherwise(segment)
    key = F.shiftleft(bit.cast("bigint"), 22).bitwiseOR(segment)
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(key.alias("key"), "fp")


def _distance(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; unsigned, as the count of a negative number is that of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(prints: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links of at most ``max_bits`` (4 or fewer) that keep together what such links join; fewer links than prints."""
    vary = int(np.bitwise_or.reduce(prints ^ prints[0])) & (2**64 - 1) if len(prints) else 0
    if len(prints) <= DIRECT or vary.bit_count() <= FEW_BITS:
        return _spread(prints, max_bits)
    bits = np.array([b for b in range(64) if vary >> b & 1], np.uint64)
    label, links = np.arange(len(prints)), []
    for segment in np.array_split(bits, len(SEGMENTS)):
        links += _met_by_segment(prints, np.uint64(1) << segment, label, max_bits)
    return links


def _spread(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """The forest by comparing each print with all that are not reached yet."""
    links, left, queue = [], prints, []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        centre = queue.pop()
        near = _distance(left, centre) <= max_bits
        reached = left[near]
        links += [(int(centre), int(x)) for x in reached]
        queue += list(reached)
        left = left[~near]
    return links


def _met_by_segment(prints: np.ndarray, bits: np.ndarray, label: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links among prints that agree in the segment of these bits or differ in one of them.

    ``label`` says which prints are joined so far; only links that join more are returned.
    """
    values = prints.view(np.uint64) & np.bitwise_or.reduce(bits)
    order = np.argsort(values, kind="stable")
    groups, first, size = np.unique(values[order], return_index=True, return_counts=True)
    links = []

    def compare(element: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Each element with a range of the order, so many pairs at a time."""
        element, start, count = element[count > 0], start[count > 0], count[count > 0]
        done = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(element):
            to = max(at + 1, int(np.searchsorted(done, done[at] + _COMPARED, "right")) - 1)
            a = order[np.repeat(element[at:to], count[at:to])]
            b = order[np.repeat(start[at:to], count[at:to]) + _within(count[at:to])]
            near = _distance(prints[a], prints[b]) <= max_bits
            links.extend(_joining(label, prints, a[near], b[near]))
            at = to

    # alike in the segment: the later ones of the same group; a crowd goes by its other bits
    few = size <= DIRECT
    here = np.repeat(first[few], size[few]) + _within(size[few])
    ends = np.repeat((first + size)[few], size[few])
    compare(here, here + 1, ends - here - 1)
    for at, n in zip(first[~few], size[~few]):
        crowd = order[at: at + n]
        place = dict(zip(prints[crowd].tolist(), crowd.tolist()))
        found = np.array([(place[u], place[v]) for u, v in forest(prints[crowd], max_bits)], np.int64).reshape(-1, 2)
        links += _joining(label, prints, found[:, 0], found[:, 1])
    # alike but for one bit: the group with the bit against that without it
    for bit in bits:
        without = np.flatnonzero(groups & bit == 0)
        other = np.minimum(np.searchsorted(groups, groups[without] | bit), len(groups) - 1)
        met = groups[other] == groups[without] | bit
        without, other = without[met], other[met]
        mine = np.repeat(first[without], size[without]) + _within(size[without])
        compare(mine, np.repeat(first[other], size[without]), np.repeat(size[other], size[without]))
    return links


def _joining(label: np.ndarray, prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between the places ``a`` and ``b`` those that join what is apart; labels become the lowest joined."""
    links = []
    while True:
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return links
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        roots, at = np.unique(high, return_index=True)
        move = np.arange(len(label))
        move[roots] = low[at]
        while (move[move] != move).any():
            move = move[move]
        label[:] = move[label]
        links += zip(prints[a[at]].tolist(), prints[b[at]].tolist())


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come by key; the last key of a batch waits for the next batch."""
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def linked(keys, prints):
        same = keys[1:] == keys[:-1]
        size = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]])))
        first = np.cumsum(size) - size
        pair = first[size == 2]
        near = _distance(prints[pair], prints[pair + 1]) <= max_bits
        u, v = [prints[pair[near]]], [prints[pair[near] + 1]]
        for at, n in zip(first[size > 2], size[size > 2]):
            if links := forest(prints[at: at + n], max_bits):
                ends = np.array(links, np.int64)
                u.append(ends[:, 0])
                v.append(ends[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        prints = np.concatenate([prints, batch.column("fp").to_numpy()])
        if not len(keys) or keys[0] == keys[-1]:
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        yield linked(keys[:cut], prints[:cut])
        keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield linked(keys, prints)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) over distinct fingerprints: enough links to join what links of ``max_bits`` join."""
    met = _variants(prints).repartition("key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(lambda batches: _links(batches, max_bits), "u bigint, v bigint").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    ).distinct()


def _classes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written (id, fp) of every row, and (fp, low, class) of every fingerprint with the smallest id that has it."""
    rows = materialize(fingerprint_rows(df, id_col, text_col))
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("low")))
    labels = component_labels(materialize(links(prints.select("fp"))))
    placed = prints.join(labels, F.col("fp") == F.col("node"), "left")
    return rows, placed.select("fp", "low", F.coalesce("component", "fp").alias("class"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component, class) for every row: its fingerprint, the smallest id it is linked to and its group.

    Null ids are never a smallest id (null where a component has no other); rows that repeat keep their
    place each; texts without words share fingerprint zero. An empty table gives an empty result.
    """
    rows, placed = _classes(df, id_col, text_col)
    lowest = placed.groupBy("class").agg(F.min("low").alias("component"))
    return rows.join(placed.join(lowest, "class").select("fp", "component", "class"), "fp").select("id", "fp", "component", "class")


def near_duplicate_report(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id."""
    return near_duplicates(df).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one document of each group of near-duplicates: the one of the smallest id.

    A row without id stays only where its whole group has none. An id may stand for several texts: the kept row
    is known by id and fingerprint, so each of their groups keeps its row; of rows that repeat both one stays.
    """
    rows, placed = _classes(df, id_col, text_col)
    # a null id comes last; of the fingerprints of one id the lowest
    first = F.min(F.struct(F.col("low").isNull().alias("nameless"), "low", "fp")).alias("first")
    kept = placed.groupBy("class").agg(first).select(F.col("first.low").alias("id"), F.col("first.fp").alias("fp"))
    repeated = rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    kept = materialize(kept.join(repeated.withColumn("repeated", F.lit(True)), "id", "left"))

    columns, taken = df.columns, {c.lower() for c in df.columns}
    own = next(name for name in (f"_print{i}" for i in range(len(taken) + 1)) if name not in taken)
    named = lambda ids: ids.select(F.col("id").alias(id_col)).distinct()
    # the kept ids grow with the documents: one plan for all sizes, never a broadcast
    single = df.join(named(kept.filter("id is not null and repeated is null")).hint("merge"), id_col, "left_semi")
    unsure = kept.filter("id is null or repeated").select(F.col("id").alias(f"{own}_id"), F.col("fp").alias(f"{own}_fp"))
    doubled = df.join(named(kept.filter("repeated")), id_col, "left_semi")
    told = _with_print(doubled.select(columns).unionByName(df.filter(F.col(id_col).isNull())), text_col, own)
    here = (F.col(own) == F.col(f"{own}_fp")) & F.col(id_col).eqNullSafe(F.col(f"{own}_id"))
    told = told.join(unsure, here, "left_semi").dropDuplicates([id_col, own])
    return single.select(columns).unionByName(told.select(columns))


def _with_print(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """All columns and the fingerprint under a name that is free."""
    def add(batches):
        for batch in batches:
            prints = fingerprints(*text_buffer(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, name])

    return df.mapInArrow(add, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))

"""Which tokens of two tokenizers stand for the same bytes, and how often over the corpus.

A is a byte-level BPE, B a sentencepiece BPE with byte fallback; both read a space and the text. Where tokens of A
and of B end at the same byte, a group ends, so groups are the finest stretches that both cut alike.

After both have tokenised a block of texts, a document is cut at anchors: bytes at which a token of A and one of B
start, both marked with a space. The ends in front of them are shared, as the bytes of either side
are first checked to be those of the text. Between anchors lies a window, mostly a word, and its alignment
depends on its ids alone. So it is worked out once for each pair of id tuples in a block: the groups,
their text, the linked id pairs and how often each occurs. Documents put it together from their windows. Tuples are
found by hash and then compared.

Each document keeps its distinct linked pairs in a written table, from which corpus counts come: a pair counts once
for each document. Pairs that make up a millionth of all (document, pair) rows or more, a million at most, go to
the tasks; the others, of which none is frequent, meet their counts in a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .rawtext import mix, range_hashes, slices, string_array, take_ranges, text_buffer
from .secrets import PRE_TOKENS

BLOCK_BYTES = 1_000_000
#: Pairs sent to the tasks, at most; each fills 17 bytes.
FREQUENT = 1_000_000
#: A linked pair is one number: A's id above, B's id below.
SHIFT = 20
_HELD = 2_000_000
_ID_VALUES = np.random.default_rng(11).integers(0, 1 << 63, 1 << SHIFT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What follows an id in the text of groups (fixed values): next of its side, other side, next group.
NEXT, OTHER, END = 0, 1, 2
_SEPARATORS = (",", "|", ";")


class Tokens:
    """Bytes of each id, and which ids begin with a space."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.spaced = np.array([t[:1] == b" " for t in texts], bool)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return take_ranges(self.data, self.starts[ids], self.lengths[ids])[0]


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """A: a byte-level BPE from a tokenizer file; special tokens in a text are ordinary text."""

    def __init__(self, content: str):
        import tiktoken

        alphabet = byte_alphabet()
        vocabulary = json.loads(content)["model"]["vocab"]
        ranks = {bytes(map(alphabet.__getitem__, name)): i for name, i in vocabulary.items()}
        self.encoding = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        names = {i: name for name, i in ranks.items()}
        self.tokens = Tokens([names.get(i, b"") for i in range(max(names) + 1)])
        self.content = content

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:
            # its pattern engine gives up on a million spaces in a row
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(self.content)
            library.encode_special_tokens = True
            return np.array(library.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokenizer:
    """B: a sentencepiece model, which puts a space in front itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        texts = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            texts.append(bytes([int(piece[3:-1], 16)]) if self.processor.is_byte(i) else piece.replace("▁", " ").encode())
        self.tokens = Tokens(texts)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.processor.encode(text), np.int64)


class Side:
    """Ids of a block's documents, end to end, with the bytes at which they start and end."""

    def __init__(self, tokens: Tokens, ids: list[np.ndarray]):
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.ends = np.cumsum(tokens.lengths[self.ids])
        self.starts = self.ends - tokens.lengths[self.ids]
        self.spaced = self.starts[tokens.spaced[self.ids]]

    def hashes(self, cuts: np.ndarray) -> np.ndarray:
        return range_hashes(_ID_VALUES[self.ids], cuts[:-1], cuts[1:])

    def same(self, cuts: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the ids of window one[i] are those of other[i]."""
        lengths = np.diff(cuts)
        equal = lengths[one] == lengths[other]
        at = np.flatnonzero(equal)
        a, offsets = take_ranges(self.ids, cuts[one[at]], lengths[one[at]])
        b, _ = take_ranges(self.ids, cuts[other[at]], lengths[one[at]])
        unlike = np.zeros(len(a) + 1, np.int64)
        np.cumsum(a != b, out=unlike[1:])
        equal[at] = unlike[offsets[1:]] == unlike[offsets[:-1]]
        return equal


class GroupText:
    """Decimal ids with what follows them, as one byte table."""

    def __init__(self, ids: int):
        texts = [f"{i}{after}".encode() for after in _SEPARATORS for i in range(ids)]
        self.size, self.table = ids, Tokens(texts)

    def of(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = after * self.size + ids
        return take_ranges(self.table.data, self.table.starts[place], self.table.lengths[place])


def alike_windows(a: Side, b: Side, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): windows of different id tuples, and which of them each window is."""
    key = mix(a.hashes(a_cuts)) + b.hashes(b_cuts)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    every = np.arange(len(which))
    same = a.same(a_cuts, every, first[which]) & b.same(b_cuts, every, first[which])
    # of different tuples with one hash, all but the first stand for themselves
    return np.unique(np.where(same, first[which], every), return_inverse=True)


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) of the distinct ids of each group, in order."""
    keys, times = np.unique((group << SHIFT) | ids, return_counts=True)
    return keys >> SHIFT, keys & ((1 << SHIFT) - 1), times


class Windows:
    """Alignments of distinct windows: groups, links, text and pairs of each."""

    def __init__(self, a: Side, b: Side, a_cuts: np.ndarray, b_cuts: np.ndarray, first: np.ndarray, text: GroupText):
        a_ids, a_to = take_ranges(a.ids, a_cuts[first], np.diff(a_cuts)[first])
        b_ids, b_to = take_ranges(b.ids, b_cuts[first], np.diff(b_cuts)[first])
        shift = a.starts[a_cuts[first]]
        width = np.append(a.ends, 0)[a_cuts[first + 1] - 1] - shift
        base = np.cumsum(width) - width
        a_ends = take_ranges(a.ends, a_cuts[first], np.diff(a_cuts)[first])[0] + np.repeat(base - shift, np.diff(a_to))
        b_ends = take_ranges(b.ends, b_cuts[first], np.diff(b_cuts)[first])[0] + np.repeat(base - shift, np.diff(b_to))
        closes_a, closes_b = np.isin(a_ends, b_ends, True), np.isin(b_ends, a_ends, True)
        a_group, b_group = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        n_groups = int(closes_a.sum())
        window = np.searchsorted(a_to, np.flatnonzero(closes_a), "right") - 1
        n = len(first)
        self.groups = np.bincount(window, minlength=n)
        sizes_a, sizes_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        links = np.zeros(n, np.int64)
        np.add.at(links, window, sizes_a * sizes_b)
        self.links = links
        # the ids of a group: A's, then B's
        order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
        after = np.concatenate([np.where(closes_a, OTHER, NEXT), np.where(closes_b, END, NEXT)])[order]
        ids = np.concatenate([a_ids, b_ids])[order]
        self.text, ends = text.of(ids, after)
        self.text_cuts = ends[a_to + b_to]
        # distinct ids of either side of a group, each with each
        (ga, da, ta), (gb, db, tb) = _distinct(a_group, a_ids), _distinct(b_group, b_ids)
        b_cut = np.searchsorted(gb, np.arange(n_groups + 1))
        partners = np.diff(b_cut)[ga]
        left = np.repeat(np.arange(len(ga)), partners)
        right, _ = take_ranges(np.arange(len(gb)), b_cut[ga], partners)
        self.pairs, self.times = (da[left] << SHIFT) | db[right], ta[left] * tb[right]
        self.pair_cuts = np.searchsorted(window[ga[left]], np.arange(n + 1))


def _sums(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, keys, values)
    return out


def aligned_block(texts: list[str | None], a_tokens: ByteTokenizer, b_tokens: PieceTokenizer, text: GroupText) -> dict:
    """Columns of the alignment for the texts of a block."""
    rows, a_ids, b_ids = [], [], []
    for row, value in enumerate(texts):
        if not value:
            continue
        a, b = a_tokens.encode(" " + value), b_tokens.encode(value)
        whole = b" " + value.encode()
        if a_tokens.tokens.joined(a).tobytes() == whole and b_tokens.tokens.joined(b).tobytes() == whole:
            rows.append(row)
            a_ids.append(a)
            b_ids.append(b)
    n = len(texts)
    if not rows:
        zero, none = np.zeros(n, np.int64), pa.array([[]] * n, pa.list_(pa.int64()))
        return {
            "n_a": pa.array(zero), "n_b": pa.array(zero), "n_groups": pa.array(zero), "n_links": pa.array(zero),
            "groups": pa.array([""] * n), "pairs": none, "times": none,
        }
    a, b = Side(a_tokens.tokens, a_ids), Side(b_tokens.tokens, b_ids)
    a_docs = np.cumsum([0, *map(len, a_ids)])
    doc_starts = a.starts[a_docs[:-1]]
    anchors = np.union1d(np.intersect1d(a.spaced, b.spaced, True), doc_starts)
    a_cuts = np.append(np.searchsorted(a.starts, anchors), len(a.ids))
    b_cuts = np.append(np.searchsorted(b.starts, anchors), len(b.ids))
    first, which = alike_windows(a, b, a_cuts, b_cuts)
    windows = Windows(a, b, a_cuts, b_cuts, first, text)
    doc = np.searchsorted(doc_starts, anchors, "right") - 1
    row = np.array(rows)
    # the text of a document's windows, without what follows its last id
    lengths = np.diff(windows.text_cuts)
    data, ends = take_ranges(windows.text, windows.text_cuts[which], lengths[which])
    ends = np.append(ends[np.searchsorted(doc, np.arange(len(rows)))], ends[-1])
    kept = np.ones(len(data), bool)
    kept[ends[1:] - 1] = False
    own = np.zeros(n, np.int64)
    own[row] = np.diff(ends) - 1
    groups = string_array(data[kept], np.concatenate([[0], np.cumsum(own)]))
    # distinct pairs of each document, from its distinct windows
    keys, repeats = np.unique(doc * len(first) + which, return_counts=True)
    of, window = keys // len(first), keys % len(first)
    sizes = np.diff(windows.pair_cuts)[window]
    names, place = np.unique(windows.pairs, return_inverse=True)
    place, _ = take_ranges(place, windows.pair_cuts[window], sizes)
    times, _ = take_ranges(windows.times, windows.pair_cuts[window], sizes)
    found, at = np.unique(np.repeat(row[of], sizes) * len(names) + place, return_inverse=True)
    times = _sums(times * np.repeat(repeats, sizes), at, len(found))
    cuts = pa.array(np.searchsorted(found // len(names), np.arange(n + 1)).astype(np.int32))
    return {
        "n_a": pa.array(_sums(np.diff(a_docs), row, n)),
        "n_b": pa.array(_sums(np.fromiter(map(len, b_ids), np.int64), row, n)),
        "n_groups": pa.array(_sums(windows.groups[which], row[doc], n)),
        "n_links": pa.array(_sums(windows.links[which], row[doc], n)),
        "groups": groups.cast(pa.string()),
        "pairs": pa.ListArray.from_arrays(cuts, pa.array(names[found % len(names)])),
        "times": pa.ListArray.from_arrays(cuts, pa.array(times)),
    }


_COLUMNS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"


def align(
    df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) for every row.

    ``groups`` is the text of a document's groups, ``a1,a2|b1;a3|b2,b3`` in ids; ``pairs`` are its distinct linked pairs
    (A's id << SHIFT | B's id) and ``times`` their occurrences. Null and empty texts, and texts that the
    tokens of either side do not spell, have zeros and nothing; null ids and repeated rows stay.
    """
    with open(byte_path, encoding="utf-8") as a_file, open(piece_path, "rb") as b_file:
        sent = df.sparkSession.sparkContext.broadcast((a_file.read(), b_file.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteTokenizer(sent.value[0]), PieceTokenizer(sent.value[1])
        text = GroupText(max(len(a.tokens.lengths), len(b.tokens.lengths)))
        for part in slices(batches, "text", block_bytes):
            columns = aligned_block(part.column("text").to_pylist(), a, b, text)
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns.values()], ["id", *columns])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_COLUMNS}").withColumnRenamed("id", id_col)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    cuts = np.zeros(len(column) + 1, np.int64)
    np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False), out=cuts[1:])
    return column.flatten().to_numpy(zero_copy_only=False), cuts


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each linked pair, and whether no pair of its A id has more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def table() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for batch in batches:
            held.append(_flat(batch.column("pairs"))[0])
            size += len(held[-1])
            if size > _HELD:
                yield table()
                held, size = [], 0
        if size:
            yield table()

    counts = materialize(
        aligned.select("pairs").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    )
    a = F.shiftright("pair", SHIFT)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def evidence(aligned: DataFrame, row_col: str, counts: DataFrame | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum): over a row's links, how many are their A id's best, and the sum of their counts.

    ``aligned`` and ``counts`` are read more than once, so they should be written tables; ``row_col`` tells
    rows apart. Pairs of at least total / ``frequent`` documents, of which there are ``frequent`` at most, are sent to the tasks.
    """
    counts = materialize(link_counts(aligned)) if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, -(-total // frequent))
    known = counts.filter(F.col("n") >= least).toArrow()
    pairs = known.column("pair").to_numpy()
    order = np.argsort(pairs)
    sent = aligned.sparkSession.sparkContext.broadcast(
        (pairs[order], known.column("n").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False).astype(bool)[order])
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = (np.append(column, column.dtype.type(0)) for column in sent.value)
        pairs[-1] = -1
        for batch in batches:
            found, cuts = _flat(batch.column("pairs"))
            times, _ = _flat(batch.column("times"))
            at = np.searchsorted(pairs[:-1], found)
            rare = np.flatnonzero(pairs[at] != found)
            at[rare] = len(pairs) - 1
            row = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            left = pa.array(np.searchsorted(rare, cuts).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(_sums(times * best[at], row, batch.num_rows)),
                    pa.array(_sums(times * n[at], row, batch.num_rows)),
                    pa.ListArray.from_arrays(left, pa.array(found[rare])), pa.ListArray.from_arrays(left, pa.array(times[rare])),
                ],
                ["row", "n_best", "count_sum", "pairs", "times"],
            )

    kind = aligned.schema[row_col].dataType.simpleString()
    rows = aligned.select(F.col(row_col).alias("row"), "pairs", "times")
    parts = rows.mapInArrow(
        score, f"row {kind}, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
    )
    if least > 1:
        parts = materialize(parts)
        rare = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
        rare = rare.join(counts.filter(F.col("n") < least), F.col("pairs") == F.col("pair")).select(
            "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
        )
        parts = parts.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
        )
    return parts.select(F.col("row").alias(row_col), "n_best", "count_sum")


def alignment_report(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of the table."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = materialize(
        align(df, byte_path, piece_path, id_col, text_col).select(
            F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), "n_a", "n_b", "n_groups", "n_links",
            digest.alias("groups_sha256"), "pairs", "times",
        )
    )
    return aligned.drop("pairs", "times").join(evidence(aligned, "_row"), "_row").select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )

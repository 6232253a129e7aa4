"""Token ids packed into fixed rows: best-fit decreasing with a segment tree of capacities.

Each document becomes the ids of a public byte-level BPE vocabulary and one end id. Documents longer than
a row are split into pieces, losslessly and in order; pieces carry their document, part number and the
position their ids start at. The pieces of a block are put, longest first, into the open row with the
least room that still holds them. A segment tree over the room left (how many rows have each room) finds
that room in logarithmic time. A block is a stretch of input rows with BLOCK_TOKENS ids or one document
more, so memory is bounded, nothing is shuffled, and a lost task is simply run again.

A packed row has its ids as a little-endian matrix row (padded with the end id), the cumulative lengths of
its segments, the position at which each segment restarts, and the documents and parts they come from.
Positions of all ids follow from these (``positions``); ``write_packed`` stores the rows as Parquet.

Pre-tokens are merged by tiktoken once per task and kept in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .rawtext import slices
from .secrets import PRE_TOKENS, _encoding, load_ranks

ROW = 2048
END_ID = 50256
BLOCK_TOKENS = 1_000_000
_KNOWN = 200_000


class RoomTree:
    """A segment tree over room sizes: which rooms have open rows, and the least one that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << int(size).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """(room, row) of least room that is at least ``needed``; the row leaves the tree."""
        node, counts = needed + self.leaves, self.counts
        while not counts[node]:
            # up until a right neighbour has rows
            while node & 1 and node > 1:
                node >>= 1
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = ROW) -> list[list[int]]:
    """Rows of piece numbers: longest pieces first, each into the tightest row; equal lengths in order."""
    tree, rows = RoomTree(size), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        found = tree.take(length)
        if found is None:
            room, row = size, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > length:
            tree.add(room - length, row)
    return rows


class PreTokens(dict):
    """Ids of pre-tokens as bytes of 32-bit numbers; those already met are looked up."""

    def __init__(self, ranks: bytes):
        super().__init__()
        self.encoding = _encoding(ranks)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(word), "<i4").tobytes()
        if len(self) >= _KNOWN:
            self.clear()
        if len(word) <= 32:
            self[word] = ids
        return ids


class Tokenizer:
    """Ids of texts."""

    def __init__(self, ranks: bytes):
        import regex

        self.known = PreTokens(ranks)
        self.cut = regex.compile(PRE_TOKENS).findall

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.cut(text))), "<i4")


def split(length: int, size: int = ROW) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` that make up a document's ids."""
    return [(a, min(a + size, length)) for a in range(0, length, size)]


def positions(cu_seqlens: list[int], starts: list[int], size: int = ROW) -> np.ndarray:
    """Position of every id of a packed row in its document; 0 in the padding."""
    out = np.zeros(size, np.int64)
    for a, b, first in zip(cu_seqlens, cu_seqlens[1:], starts):
        out[a:b] = np.arange(first, first + b - a)
    return out


SCHEMA = (
    "pack_id bigint, ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<{kind}>, parts array<int>"
)


def pack(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = ROW, end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Packed rows of all documents of ``df``; ids are 32-bit.

    A null or empty text is its end id alone, null ids stay null in ``doc_ids``, repeated rows are packed
    each, and an empty table gives no row. ``pack_id`` is unique; which documents share a row follows the
    order of the input.
    """
    sent = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = df.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(sent.value)
        number = TaskContext.get().partitionId() << 36
        documents, held, id_type = [], 0, None

        def close():
            nonlocal number
            pieces = [(d, part, a, b) for d, (_, ids) in enumerate(documents) for part, (a, b) in enumerate(split(len(ids), size))]
            rows = best_fit_decreasing(np.array([b - a for *_, a, b in pieces], np.int64), size)
            for at in range(0, len(rows), 256):
                some = [[pieces[p] for p in row] for row in rows[at: at + 256]]
                matrix = np.full((len(some), size), end_id, "<i4")
                ends = []
                for line, row in enumerate(some):
                    ends.append(np.concatenate([[0], np.cumsum([b - a for *_, a, b in row])]).astype(np.int32))
                    for (d, _, a, b), x, y in zip(row, ends[-1], ends[-1][1:]):
                        matrix[line, x:y] = documents[d][1][a:b]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(number, number + len(some))),
                    pa.array([line.tobytes() for line in matrix], pa.binary()),
                    pa.array([int(e[-1]) for e in ends], pa.int32()),
                    pa.array([e.tolist() for e in ends], pa.list_(pa.int32())),
                    pa.array([[a for _, _, a, _ in row] for row in some], pa.list_(pa.int32())),
                    pa.array([[documents[d][0] for d, *_ in row] for row in some], pa.list_(id_type)),
                    pa.array([[part for _, part, _, _ in row] for row in some], pa.list_(pa.int32())),
                ], ["pack_id", "ids", "n_ids", "cu_seqlens", "position_resets", "doc_ids", "parts"])
                number += len(some)

        for part in slices(batches, "text", 1_000_000):
            id_type = part.column("id").type
            for own, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                ids = np.append(tokenizer.ids(text or ""), np.int32(end_id))
                documents.append((own, ids))
                held += len(ids)
                if held >= block_tokens:
                    yield from close()
                    documents, held = [], 0
        if documents:
            yield from close()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(packed, SCHEMA.format(kind=kind))


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet; the ids of a row are one binary cell of 4 * size bytes."""
    packed.write.parquet(path)

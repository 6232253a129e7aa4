"""Texts as Arrow buffers: whole-batch word spans, word hashes and per-document sums in numpy.

White space is ``[\\x20\\x09-\\x0D]`` and lower case is ASCII only, so both work on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: White space of the word definition (fixed values).
SPACE_BYTES = b" \t\n\x0b\x0c\r"
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE_BYTES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: A random 64-bit value for each byte.
_BYTE_VALUES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def crc_fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as fold 1, so it is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(parts)), F.lit(1))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut at rows so that a slice holds ``max_bytes`` of the column, or one longer row."""
    for batch in batches:
        ends = text_buffer(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + max_bytes, "right")) - 1
            last = max(last, first + 1)
            yield batch.slice(first, last - first)
            first = last
    # the worker lives on: what the next operator needs should not come on top
    pa.default_memory_pool().release_unused()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. Row i is bytes[offsets[i]:offsets[i + 1]]."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def word_spans(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, cuts): words as byte ranges; row i has words cuts[i]:cuts[i + 1]."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = inside[1:] != inside[:-1]
    # a word also starts and ends where a row does
    border = np.unique(offsets[1:-1])
    border = border[(border > 0) & (border < len(data))]
    glued = border[inside[border] & inside[border + 1]]
    marks = np.flatnonzero(edge)
    if len(glued):
        marks = np.sort(np.concatenate([marks, glued, glued]), kind="stable")
    starts, ends = marks[::2], marks[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        powers = np.full(n, base, np.uint64)
        powers[:1] = 1
        _powers[name] = np.multiply.accumulate(powers)
    return _powers[name][:n]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by differences of one polynomial prefix sum."""
    return range_hashes(_BYTE_VALUES[data], starts, ends)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of a sequence that is given by a random 64-bit value for each element."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power("up", _MULTIPLIER, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", _INVERSE, n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def take_ranges(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): the ranges starts[i]:starts[i] + lengths[i] of the data, one after the other."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    places = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return data[places], offsets


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings from UTF-8 bytes and the offsets of each."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers)


def row_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[i]:cuts[i + 1]]; zero where that is empty."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[cuts[1:]] - sums[cuts[:-1]]

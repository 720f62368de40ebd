"""Flat numpy views of text columns: byte buffers with offsets, word bounds, segment hashes, ragged gathers.

Arrow hands a text column to a task as one byte buffer with offsets. The operators
work on that buffer with whole-array steps instead of one Python object a row, in
blocks of bounded size (a single longer text is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of a text column: first row, end row, bytes, offsets within the block."""
    data, offsets = text_buffer(col)
    for i, j in blocks(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], np.uint64))[0])


@cache
def _unit_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        if size > 4 * BLOCK_BYTES:  # a single huge text: not kept
            return out[0], out[1]
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


class SegmentHash:
    """64-bit hashes of any segments of one unit array (bytes or code points) after one pass."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self._pow, self._inv = _powers(n + 1)
        vals = _unit_table()[units] if units.dtype == np.uint8 else mix(units.astype(np.uint64) + np.uint64(1))
        vals *= self._pow[:n]
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(vals, out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inv[start])

    def fixed(self, width: int) -> np.ndarray:
        """Unmixed hashes of all windows of ``width`` units."""
        n = len(self._sum) - width
        return (self._sum[width:] - self._sum[:n]) * self._inv[:n] if n > 0 else np.zeros(0, np.uint64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words [^\\x20\\x09-\\x0D]+, and per row the index of its first word (n + 1 values)."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by sorting (numpy's own ``unique`` hashes, which takes many times longer)."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows of ``lengths``: the row of each element and its place in the row."""
    lengths = np.asarray(lengths, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return row, np.arange(len(row)) - first[row]


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[starts[i] : starts[i] + lengths[i]]."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return values[np.repeat(np.asarray(starts, np.int64) - first, lengths) + np.arange(total)]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i] : bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class HashCache:
    """64-bit hash -> int64, kept in a worker between blocks; emptied when it would hold over ``limit`` entries."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys`` ascend and are new."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


class OpenTable:
    """int64 key >= 0 -> int64 value >= 0 by linear probing; the caller keeps it at most half full."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not held yet."""
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            done = np.zeros(len(keys), bool)
            done[placed] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is not held."""
        slot = self._slot(keys)
        held = self.keys[slot]
        lost = np.flatnonzero((held != keys) & (held >= 0))
        while len(lost):
            slot[lost] = (slot[lost] + 1) & ((1 << self.bits) - 1)
            held[lost] = self.keys[slot[lost]]
            lost = lost[(held[lost] != keys[lost]) & (held[lost] >= 0)]
        return np.where(held == keys, self.values[slot], -1)

"""Whole columns of text as numpy arrays: words, their hashes, and shingles, without a Python loop per word.

A word is a run of bytes other than ASCII white space. Hashing is a polynomial over the bytes modulo
2**64 with random coefficients, read off prefix sums, so a word costs the same however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once. Bounds the working memory of a task, whatever the size of a partition.
PIECE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
_STEP = [np.uint64(x | 1) for x in _RNG.integers(1, 2**63, 16, dtype=np.uint64)]


def powers(of: int, n: int) -> np.ndarray:
    have = _POWERS.get(of)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES + 1), of, np.uint64)
        have[0] = 1
        have = _POWERS[of] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in ``column``, or one row."""
    if not len(batch):
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of each text of a column: ``start`` and ``end`` in ``data``, ``hash``; those of row i are
    at ``first[i]:first[i + 1]``."""

    def __init__(self, column: pa.Array, lower: bool = True):
        self.raw, self.offsets = flat(column)
        self.data = LOWER[self.raw] if lower else self.raw
        n = len(self.data)
        solid = ~SPACE[self.data]
        opens, closes = solid.copy(), solid.copy()
        if n:
            opens[1:] &= ~solid[:-1]
            closes[:-1] &= ~solid[1:]
            inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            opens[inner] = solid[inner]
            closes[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self._hash = self._sums = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def count(self) -> np.ndarray:
        """Words of each row."""
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.count)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` to ``end``, the same wherever the bytes stand."""
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * powers(_BASE, len(self.data)), out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * powers(_INVERSE, len(self.data) + 1)[start])

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.hash_of(self.start, self.end)
        return self._hash

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words inside a row, and the index of each run's first word."""
        n = len(self) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = self.hash
        total = h[:n] * _STEP[0]
        for j in range(1, k):
            total = total + h[j : j + n] * _STEP[j]
        row = self.row
        at = np.flatnonzero(row[:n] == row[k - 1 :])
        return mix(total[at]), at

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """Sorted distinct k-word shingles of each row; a row of fewer words is one shingle, an empty one none."""
        values, at = self.shingles(k)
        cut = np.searchsorted(at, self.first)
        sets = []
        for i, n in enumerate(self.count.tolist()):
            if n >= k:
                sets.append(np.unique(values[cut[i] : cut[i + 1]]))
            elif n:
                h = self.hash[self.first[i] : self.first[i + 1]]
                sets.append(mix(np.array([sum(int(x) * int(_STEP[j + 1]) for j, x in enumerate(h)) + n & (2**64 - 1)], np.uint64)))
            else:
                sets.append(values[:0])
        return sets


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.astype(np.uint64).view(np.int64)

"""Counting and looking up 64-bit codes in numpy, by direct addressing with sorting only for what collides."""

from __future__ import annotations

import numpy as np

_BITS = 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)


class Counter:
    """Counts of unsigned codes, given an array at a time."""

    def __init__(self):
        self.owner = np.zeros(1 << _BITS, np.uint64)
        self.taken = np.zeros(1 << _BITS, bool)
        self.counts = np.zeros(1 << _BITS, np.int64)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, codes: np.ndarray) -> None:
        slots = _slots(codes)
        free = ~self.taken[slots]
        self.owner[slots[free]] = codes[free]
        self.taken[slots[free]] = True
        own = self.owner[slots] == codes
        self.counts += np.bincount(slots[own], minlength=1 << _BITS)
        if not own.all():
            self.rest.append(np.unique(codes[~own], return_counts=True))
            self.size += len(self.rest[-1][0])
            if self.size > 4_000_000 and len(self.rest) > 1:
                self.rest = [summed(self.rest)]
                self.size = len(self.rest[0][0])

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes, sorted, and their counts."""
        return summed([(self.owner[self.taken], self.counts[self.taken]), *self.rest])


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several (codes, counts) added up, by ascending code."""
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    opens = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[opens], np.add.reduceat(counts, opens)


class Lookup:
    """Values of sorted distinct codes; every code asked for must be among them."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values
        self.owner = np.zeros(1 << _BITS, np.uint64)
        self.at = np.zeros(1 << _BITS, np.int32)
        slots = _slots(codes)
        self.owner[slots], self.at[slots] = codes, np.arange(len(codes), dtype=np.int32)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        slots = _slots(codes)
        at = self.at[slots]
        other = np.flatnonzero(self.owner[slots] != codes)
        at[other] = np.searchsorted(self.codes, codes[other])
        return self.values[at]

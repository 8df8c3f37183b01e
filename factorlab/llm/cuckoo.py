"""A cuckoo filter of 128-bit keys: membership with rare false alarms, insertions and deletions."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_KICKS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Buckets of 4 marks of 16 bits. A key is given as two unsigned 64-bit numbers.

    The first places the key, the second makes its mark; the other bucket is the place xor a hash
    of the mark. When a key finds no slot the filter doubles from the keys handed to ``build``.
    """

    def __init__(self, buckets: int):
        self.size = 1 << max(0, int(np.ceil(np.log2(max(buckets, 1)))))
        self.table = np.zeros((self.size, SLOTS), np.uint16)
        self.count = 0

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> CuckooFilter:
        """A filter that holds all keys; made larger until it does."""
        buckets = max(1, int(len(high) / SLOTS / 0.9))
        while True:
            made = cls(buckets)
            if all(made.insert(h, x) for h, x in zip(high, low)):
                return made
            buckets = made.size * 2

    def _marks(self, low: np.ndarray) -> np.ndarray:
        return (low % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _places(self, high, low):
        marks = self._marks(np.atleast_1d(np.asarray(low, np.uint64)))
        first = np.atleast_1d(np.asarray(high, np.uint64)) & np.uint64(self.size - 1)
        return marks, first, self._other(first, marks)

    def _other(self, place, mark):
        with np.errstate(over="ignore"):
            return place ^ (mark.astype(np.uint64) * _MIX >> np.uint64(32)) & np.uint64(self.size - 1)

    def insert(self, high, low) -> bool:
        marks, a, b = self._places(high, low)
        mark = marks[0]
        for place in (int(a[0]), int(b[0])):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                self.count += 1
                return True
        place = int(b[0])
        for kick in range(_KICKS):
            slot = kick % SLOTS
            mark, self.table[place, slot] = self.table[place, slot], mark
            place = int(self._other(np.uint64(place), mark))
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                self.count += 1
                return True
        return False

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        marks, a, b = self._places(high, low)
        return ((self.table[a] == marks[:, None]) | (self.table[b] == marks[:, None])).any(axis=1)

    def delete(self, high, low) -> bool:
        """Take one mark of a key out; only of keys that were inserted."""
        marks, a, b = self._places(high, low)
        for place in (int(a[0]), int(b[0])):
            held = np.flatnonzero(self.table[place] == marks[0])
            if len(held):
                self.table[place, held[0]] = 0
                self.count -= 1
                return True
        return False

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        made = cls(len(table))
        made.table, made.count = table, int((table != 0).sum())
        return made

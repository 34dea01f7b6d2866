"""A hash table in numpy from 64-bit word hashes to row numbers, for results that a worker keeps."""

from __future__ import annotations

import numpy as np


class Memo:
    """Open addressing with linear probes, at most half full. ``find`` and ``add`` take whole arrays.

    It holds ``most`` hashes, which is at least the number asked for: arrays beside it take their size from it.
    """

    def __init__(self, most: int):
        bits = max(10, (2 * int(most) - 1).bit_length())
        self.most = 1 << (bits - 1)
        self._mask = np.int64((1 << bits) - 1)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._rows = np.full(1 << bits, -1, np.int32)
        self.size = 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.int64) & self._mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row number of each hash, -1 where it isn't held."""
        slot = self._slots(hashes)
        rows = self._rows[slot]
        left = np.flatnonzero((rows >= 0) & (self._keys[slot] != hashes))
        while len(left):
            slot[left] = (slot[left] + 1) & self._mask
            rows[left] = self._rows[slot[left]]
            left = left[(rows[left] >= 0) & (self._keys[slot[left]] != hashes[left])]
        return rows

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Takes in distinct hashes that aren't held; returns their row numbers."""
        rows = np.arange(self.size, self.size + len(hashes), dtype=np.int32)
        slot = self._slots(hashes).copy()
        left = np.arange(len(hashes))
        while len(left):
            free = left[self._rows[slot[left]] < 0]
            self._rows[slot[free]] = rows[free]
            self._keys[slot[free]] = hashes[free]
            left = left[self._rows[slot[left]] != rows[left]]
            slot[left] = (slot[left] + 1) & self._mask
        self.size += len(hashes)
        return rows

    def room(self, n: int) -> bool:
        return self.size + n <= self.most

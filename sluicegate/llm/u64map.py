"""Open-addressing hash map from 64-bit keys to 32-bit values, on numpy arrays."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class U64Map:
    """Vectorised insert and lookup with linear probing; holds at most half its slots."""

    def __init__(self, limit: int):
        bits = max(4, int(limit * 2 - 1).bit_length())
        self.limit, self.size = limit, 0
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)  # 0: free
        self.values = np.full(1 << bits, -1, np.int32)

    def _start(self, keys):
        keys = np.where(keys == 0, _MIX, keys) if (keys == 0).any() else keys
        return keys, ((keys * _MIX) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where absent."""
        keys, slot = self._start(keys)
        there = self.keys[slot]
        out = self.values[slot]
        off = there != keys
        if off.any():
            out[off] = -1
            todo = np.flatnonzero(off & (there != 0))
            k, s = keys[todo], slot[todo]
            while len(todo):
                s = (s + 1) & self._mask
                there = self.keys[s]
                hit = there == k
                out[todo[hit]] = self.values[s[hit]]
                go = ~hit & (there != 0)
                todo, k, s = todo[go], k[go], s[go]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys, each of them new and given once."""
        if self.size + len(keys) > self.limit:
            raise ValueError("map is full")
        self.size += len(keys)
        keys, slot = self._start(keys)
        values = values.astype(np.int32)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[free]
            won = np.zeros(len(keys), bool)
            won[free] = self.keys[slot[free]] == keys[free]
            self.values[slot[won]] = values[won]
            rest = ~won
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self._mask

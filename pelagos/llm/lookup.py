"""Tables of values by key that tasks hold."""

from __future__ import annotations

import numpy as np

from .bytesvec import mix

#: Rows of a table that passes through the driver to all tasks at most: 12 bytes each.
SHARD_ROWS = 1_000_000


class Lookup:
    """A hash table in arrays: unsigned 64-bit keys, one value each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.bits = max(16, int(len(keys)).bit_length())
        tops = self.keys >> np.uint64(64 - self.bits)
        self.starts = np.searchsorted(tops, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in ``values``, -1 where there is none. Keys must be well mixed."""
        at = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return at
        top = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left, end = self.starts[top].astype(np.int64), self.starts[top + 1].astype(np.int64)
        todo = np.flatnonzero(left < end)
        place = left[todo]
        while len(todo):
            hit = self.keys[place] == keys[todo]
            at[todo[hit]] = place[hit]
            rest = ~hit & (place + 1 < end[todo])
            todo, place = todo[rest], place[rest] + 1
        return at

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        at = self.find(keys)
        if not len(self.values):
            return np.full(len(keys), default)
        return np.where(at >= 0, self.values[at], default)


def pair_key(*parts: np.ndarray) -> np.ndarray:
    """One well-mixed key from the hashes of consecutive items."""
    key = parts[0]
    for p in parts[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + p)
    return key

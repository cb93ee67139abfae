"""A hash table from integers to integers that is read and written by whole numpy arrays."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """Open addressing with linear probing, at most half full. Keys are below 2**64 - 1."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None, bits: int = 4):
        self.count = 0
        self._clear(bits)
        if keys is not None:
            self.add(keys, values)

    def _clear(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, dtype=np.uint64)  # stored plus one: 0 is a free slot
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        last = len(self.keys) - 1
        rest, at = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[rest[free]] + np.uint64(1)  # of several for one slot, one stays
            placed = self.keys[at] == keys[rest] + np.uint64(1)
            self.values[at[placed]] = values[rest[placed]]
            rest, at = rest[~placed], (at[~placed] + 1) & last

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        keys, values = np.asarray(keys, dtype=np.uint64), np.asarray(values, dtype=np.int32)
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            used = self.keys != 0
            old, old_values = self.keys[used] - np.uint64(1), self.values[used]
            self._clear(max(4, int(4 * self.count - 1).bit_length()))
            self._place(old, old_values)
        self._place(keys, values)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        """Values of the keys; ``missing`` where there is none."""
        stored, at, last = keys + np.uint64(1), self._slot(keys), len(self.keys) - 1
        found = self.keys[at]
        searching = np.flatnonzero((found != stored) & (found != 0))
        while len(searching):
            at[searching] = (at[searching] + 1) & last
            found[searching] = self.keys[at[searching]]
            searching = searching[(found[searching] != stored[searching]) & (found[searching] != 0)]
        return np.where(found == 0, np.int32(missing), self.values[at])

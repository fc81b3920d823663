"""Minimal perfect hashing of 64-bit keys: n keys to the slots 0..n-1, with stored fingerprints.

Keys fall into buckets of four on average. Buckets are placed from the largest
to the smallest: each takes the first displacement that sends its keys to free,
distinct slots; buckets of one key store their slot itself. A lookup computes
one bucket, one slot and one fingerprint, whatever n is.
"""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 256
MOST = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finalizer with full avalanche (multiply and shift)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """One key for each (id, how many equal ids came before it)."""
    return mix(ids.astype(np.int64).view(np.uint64) + _STEP) ^ mix(occurrence.astype(np.uint64) * _STEP + np.uint64(1))


def occurrences(sorted_ids: np.ndarray) -> np.ndarray:
    at = np.arange(len(sorted_ids))
    first = np.r_[True, sorted_ids[1:] != sorted_ids[:-1]] if len(at) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(first, at, 0))


class PerfectHash:
    def __init__(self, n: int, seed: int, displacement: np.ndarray, fingerprint: np.ndarray):
        self.n, self.seed, self.displacement, self.fingerprint = n, seed, displacement, fingerprint

    @staticmethod
    def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
        return mix(keys + np.uint64(seed) * _STEP)

    @staticmethod
    def _prints(keys: np.ndarray) -> np.ndarray:
        return (mix(keys * _STEP + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The function and the slot of each key; keys must be distinct."""
        for seed in range(1, 64):
            found = cls._try(keys, seed)
            if found is not None:
                return found
        raise ValueError("keys are not distinct")

    @classmethod
    def _try(cls, keys: np.ndarray, seed: int):
        n = len(keys)
        buckets = max(1, -(-n // 4))
        h = cls._hash(keys, seed)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=buckets)
        start = np.r_[0, np.cumsum(size)]
        slot, free = np.zeros(n, np.int64), np.ones(n, bool)
        displacement = np.zeros(buckets, np.int32)
        for b in np.argsort(-size, kind="stable"):
            members = order[start[b] : start[b + 1]]
            if len(members) < 2:
                break
            for d0 in range(0, MOST, BLOCK):
                d = np.arange(d0, d0 + BLOCK, dtype=np.uint64)
                slots = (mix(h[members][:, None] + d[None, :] * _STEP) % np.uint64(n)).astype(np.int64)
                ranked = np.sort(slots, axis=0)
                good = np.flatnonzero(free[slots].all(axis=0) & (ranked[1:] != ranked[:-1]).all(axis=0))
                if len(good):
                    displacement[b] = d0 + good[0]
                    slot[members] = slots[:, good[0]]
                    free[slots[:, good[0]]] = False
                    break
            else:
                return None
        single = np.flatnonzero(size == 1)
        places = np.flatnonzero(free)
        displacement[single] = -1 - places
        slot[order[start[single]]] = places
        prints = np.zeros(n, np.uint32)
        prints[slot] = cls._prints(keys)
        return cls(n, seed, displacement, prints), slot

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the stored fingerprint is not the key's."""
        if not self.n:
            return np.full(len(keys), -1)
        h = self._hash(keys, self.seed)
        d = self.displacement[(h % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        moved = (mix(h + np.maximum(d, 0).astype(np.uint64) * _STEP) % np.uint64(self.n)).astype(np.int64)
        slot = np.where(d < 0, -1 - d, moved)
        return np.where(self.fingerprint[slot] == self._prints(keys), slot, -1)

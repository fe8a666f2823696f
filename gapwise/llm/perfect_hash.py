"""A minimal perfect hash of 64-bit keys, with the keys stored by slot so that others are told apart."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gapwise.llm.words import mixed

U = np.uint64
#: Keys per bucket on average.
BUCKET = 2


def _ranged(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes as numbers below n < 2^31."""
    return (((h >> U(33)) * U(n)) >> U(31)).astype(np.int64)


def _slot(h: np.ndarray, shift: np.ndarray | int, n: int) -> np.ndarray:
    return _ranged(mixed(h + np.asarray(shift).astype(U) * U(0x9E3779B97F4A7C15)), n)


@dataclass(frozen=True)
class PerfectHash:
    """``shifts`` by bucket lead each key to a slot of its own; a bucket of one key names its slot as -1 - slot."""

    shifts: np.ndarray
    keys: np.ndarray

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that isn't stored."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        h = mixed(keys.astype(U))
        shift = self.shifts[_ranged(h, len(self.shifts))]
        at = np.where(shift < 0, -1 - shift, _slot(h, np.maximum(shift, 0), len(self.keys)))
        return np.where(self.keys[at] == keys, at, -1)


def build(keys: np.ndarray) -> PerfectHash:
    """Of distinct keys. Buckets are placed from the largest down, all of one size at a time: each tries the next shift until its
    keys fall on free slots that no other bucket of the round takes; buckets of one key get the slots that are left."""
    n = len(keys)
    if n >= 1 << 31:
        raise ValueError("too many keys for one table")
    m = max(1, n // BUCKET)
    shifts, stored = np.zeros(m, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return PerfectHash(shifts, stored)
    h = mixed(keys.astype(U))
    bucket = _ranged(h, m)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    first = np.cumsum(sizes) - sizes
    free, owner = np.ones(n, dtype=bool), np.full(n, -1, dtype=np.int64)
    for size in range(int(sizes.max()), 1, -1):
        open_ = np.flatnonzero(sizes == size)
        if not len(open_):
            continue
        members = order[first[open_][:, None] + np.arange(size)]
        shift = 0
        while len(open_):
            slots = _slot(h[members], shift, n)
            owner[slots] = np.arange(len(open_))[:, None]
            alone = (owner[slots] == np.arange(len(open_))[:, None]).all(axis=1) & free[slots].all(axis=1)
            # Two keys of one bucket on one slot: sorted neighbours are equal.
            ordered = np.sort(slots, axis=1)
            alone &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            shifts[open_[alone]] = shift
            free[slots[alone]] = False
            stored[slots[alone]] = keys[members[alone]]
            open_, members, shift = open_[~alone], members[~alone], shift + 1
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    shifts[single], stored[left] = -1 - left, keys[order[first[single]]]
    return PerfectHash(shifts, stored)

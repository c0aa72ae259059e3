"""Sharded minimal perfect hashes over byte keys, with the keys stored for verification.

A shard holds a few thousand keys.  They are cut into buckets of two keys on average; buckets, fullest
first, look for a displacement under which all their keys fall on free slots, and a bucket of one key
names its slot outright.  A shard of n keys has exactly n slots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mixed

KEYS_PER_SHARD = 4096
TRIES = 64  # displacements tried at once


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(h) % np.uint64(shards)).astype(np.int64)


def _buckets(n: int) -> int:
    return n // 2 + 1


def _slots(h: np.ndarray, displacement: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(h + (displacement.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % n.astype(np.uint64)).astype(np.int64)


def build(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(displacements, slot of every key)`` of one shard; the keys are distinct."""
    n = len(keys)
    h = hashes(keys)
    if len(np.unique(h)) < n:
        raise ValueError("two keys of a shard share a 64-bit hash")
    displacement = np.zeros(_buckets(n), dtype=np.int32)
    slot = np.full(n, -1, dtype=np.int64)
    bucket = (h % np.uint64(len(displacement))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    count = np.bincount(bucket, minlength=len(displacement))
    start = np.cumsum(count) - count
    free = np.ones(n, dtype=bool)
    for b in sorted(np.flatnonzero(count > 1), key=lambda b: (-count[b], b)):
        members = order[start[b] : start[b] + count[b]]
        first = 0
        while True:
            tried = np.arange(first, first + TRIES)
            at = _slots(h[members][None, :], tried[:, None], np.array(n))
            good = free[at].all(1)
            if len(members) == 2:
                good &= at[:, 0] != at[:, 1]
            else:
                good &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(1)
            if good.any():
                break
            first += TRIES
        i = int(good.argmax())
        displacement[b], slot[members] = tried[i], at[i]
        free[at[i]] = False
    left = iter(np.flatnonzero(free).tolist())
    for b in np.flatnonzero(count == 1):
        s = next(left)
        displacement[b], slot[order[start[b]]] = -s - 1, s
    return displacement, slot


@dataclass
class Hashes:
    """The shards of one key set, one after the other; ``numbers`` are their names, in order, of ``shards`` in all."""

    shards: int
    numbers: np.ndarray
    sizes: np.ndarray
    displacements: list[np.ndarray]
    keys: pa.Array  # large binary, in slot order

    def __post_init__(self):
        self.place = np.full(self.shards, -1, dtype=np.int64)
        self.place[self.numbers] = np.arange(len(self.numbers))
        self.first = np.cumsum(self.sizes) - self.sizes
        widths = np.array([len(d) for d in self.displacements], dtype=np.int64)
        self.widths, self.at = widths, np.cumsum(widths) - widths
        self.flat = np.concatenate([np.zeros(0, np.int32), *self.displacements])

    def __len__(self) -> int:
        return int(self.sizes.sum())

    def __getstate__(self):
        return self.shards, self.numbers, self.sizes, self.displacements, self.keys

    def __setstate__(self, state):
        self.shards, self.numbers, self.sizes, self.displacements, self.keys = state
        self.__post_init__()

    def find(self, words: pa.Array, h: np.ndarray) -> np.ndarray:
        """Slot of every word, counted over all held shards; -1 where the stored key is another one."""
        found = np.full(len(words), -1, dtype=np.int64)
        place = self.place[shard_of(h, self.shards)]
        i = np.flatnonzero(place >= 0)
        i = i[self.sizes[place[i]] > 0]
        if not len(i):
            return found
        p, h = place[i], h[i]
        d = self.flat[self.at[p] + (h % self.widths[p].astype(np.uint64)).astype(np.int64)].astype(np.int64)
        named = d < 0
        slot = np.where(named, -d - 1, _slots(h, np.where(named, 0, d), self.sizes[p]))
        slot = self.first[p] + np.minimum(slot, self.sizes[p] - 1)
        same = pc.equal(self.keys.take(pa.array(slot)), words.take(pa.array(i)))
        found[i] = np.where(same.to_numpy(zero_copy_only=False), slot, -1)
        return found

    def address(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(shard, slot inside the shard)``."""
        p = np.searchsorted(self.first + self.sizes, slots, side="right")
        return self.numbers[p], slots - self.first[p]

"""Links between alike things: equal keys bring them together, a proof decides.

Things are ``hash, size, keys``; whatever shares a key meets in a bucket, read off a sorted stream.  Buckets are
cut into tiles and every pair of tiles is a unit of search of its own, so no group of copies has to fit anywhere.  In a unit things
are taken one after the other and compared only with those not yet connected to them, so a bucket of
copies costs one proof for each member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard
from .common import expand, list_array, mixed, record_batch
from .simhash import whole_units

TILE = 4096
# windows hashed at once: they stay in the cache
WINDOWS_AT_ONCE = 1 << 15
# rows of units searched at once
UNIT_ROWS = 1 << 14
# pairs that wait for a proof together; those of the first step do not wait, so that copies are soon connected
PROOFS = 1 << 14
# units are searched in so many rounds at most, of so many rows at least: what a round shuffles is dropped with its end
ROUNDS, ROUND_ROWS = 6, 1 << 16
BUCKETS = "no int, key bigint, own int, hashes array<bigint>, sizes array<int>"
LINKS = "a bigint, b bigint"
# held values of many units -> pairs (row, row, larger size) -> mask
Prepared = Callable[[list[bytes]], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


def min_keys(values: np.ndarray, counts: np.ndarray, rows: int, bands: int, seed: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """``bands`` keys of every set of hashes (``counts`` of ``values``, one at least): each is made of ``rows`` smallest members.

    Of several ``parts`` one is asked for: every so many bands from ``part`` on, with the keys they have among all.
    The upper halves of the hashes are compared: 32 bits are enough for an order, and half the work.
    """
    asked = range(part, bands, parts)
    out = np.zeros((len(counts), len(asked)), dtype=np.uint64)
    ends = np.cumsum(counts)
    turn = np.random.default_rng(seed).integers(0, 1 << 32, (bands, rows, 2), dtype=np.uint32)
    half = (values >> np.uint64(32)).astype(np.uint32)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(counts):
            begin = int(ends[first] - counts[first])
            last = max(int(np.searchsorted(ends, begin + WINDOWS_AT_ONCE, side="right")), first + 1)
            some, starts = half[begin : ends[last - 1]], ends[first:last] - counts[first:last] - begin
            for at, band in enumerate(asked):
                key = np.full(last - first, seed + band, dtype=np.uint64)
                for flip, odd in turn[band]:
                    key = mixed(key + np.minimum.reduceat((some ^ flip) * (odd | np.uint32(1)), starts))
                out[first:last, at] = key
            first = last
    return out.view(np.int64)


class _Buckets:
    """Buckets from a stream of ``key, hash, size`` in the order of key and hash: never more than a batch and a tile are held."""

    def __init__(self, similarity: float, tile: int):
        self.similarity, self.tile = similarity, tile
        self.key = self.hash = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)
        self.done = 0  # tiles already given of the last key

    def add(self, key: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, hashes, size = np.append(self.key, key), np.append(self.hash, hashes), np.append(self.size, size)
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])
        yield from self._cut(key[new], hashes[new], size[new], False)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._cut(self.key, self.hash, self.size, True)

    def _cut(self, key: np.ndarray, hashes: np.ndarray, size: np.ndarray, end: bool) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        count = np.diff(np.append(first, len(key)))
        whole = count <= self.tile
        if len(first):
            whole[0] &= self.done == 0
            whole[-1] &= end
        at = expand(first[whole], count[whole])
        yield self._small(key[at], hashes[at], size[at])
        held = len(key)
        for f, n in zip(first[~whole].tolist(), count[~whole].tolist()):
            open_end = f + n == len(key) and not end
            begin = f
            # a row of the last key stays, so that a repeat of it in the next batch is seen
            while n - (begin - f) > (self.tile if open_end else 0):
                stop = min(begin + self.tile, f + n)
                yield self._rows([1], [key[f]], [self.done], hashes[begin:stop], size[begin:stop], np.array([stop - begin]))
                self.done += 1
                begin = stop
            if open_end:
                held = begin
            else:
                self.done = 0
        self.key, self.hash, self.size = key[held:], hashes[held:], size[held:]

    def _small(self, key: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        """Buckets of one tile, cut where sizes are too far apart, named by their members."""
        order = np.lexsort((hashes, size, key))
        key, hashes, size = key[order], hashes[order], size[order]
        apart = np.ones(len(key), dtype=bool)
        apart[1:] = (key[1:] != key[:-1]) | (size[1:] - size[:-1] > (1.0 - self.similarity) * size[1:] + 1e-9)
        first = np.flatnonzero(apart)
        count = np.diff(np.append(first, len(key)))
        first, count = first[count > 1], count[count > 1]
        at = expand(first, count)
        hashes, size = hashes[at], size[at]
        starts = np.cumsum(count) - count
        with np.errstate(over="ignore"):
            names = mixed(np.add.reduceat(mixed(hashes.view(np.uint64)), starts) + count.astype(np.uint64)) if len(count) else np.zeros(0, dtype=np.uint64)
        return self._rows(np.zeros(len(count), dtype=np.int32), names.view(np.int64), np.zeros(len(count), dtype=np.int32), hashes, size, count)

    @staticmethod
    def _rows(no, key, own, hashes: np.ndarray, size: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return record_batch(BUCKETS, [no, key, own, list_array(hashes, count, pa.int64()), list_array(size, count, pa.int32())])


def buckets(things: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """``no, key, own, hashes, sizes``: lists of at most ``tile`` different things that share a key.

    A bucket of more is several rows (``no`` 1) with the tile's number ``own``.  Small ones are cut where the
    next size is too far to be alike, and those with the same members are one row: most pairs share many keys.
    One exchange of (key, hash, size), and no count before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Buckets(similarity, tile)
        for batch in batches:
            yield from found.add(*(batch.column(i).to_numpy() for i in range(3)))
        yield from found.end()

    met = things.select(F.explode("keys").alias("key"), "hash", "size").repartition("key").sortWithinPartitions("key", "hash")
    return met.mapInArrow(run, BUCKETS).dropDuplicates(["no", "key", "own"])


def units(found: DataFrame) -> DataFrame:
    """``no, key, low, high, own, hash, size`` of ``buckets``: every pair of tiles of a bucket is a unit."""
    tiles = found.where("no = 1").groupBy("no", "key").agg((F.max("own") + 1).alias("_tiles"))
    dealt = found.join(tiles, ["no", "key"], "left").withColumn("_t", F.explode(F.sequence(F.lit(0), F.coalesce("_tiles", F.lit(1)) - 1)))
    return dealt.select("no", "key", F.least("own", "_t").alias("low"), F.greatest("own", "_t").alias("high"), "own", F.explode(F.arrays_zip("hashes", "sizes")).alias("_m")).select(
        "no", "key", "low", "high", "own", F.col("_m.hashes").alias("hash"), F.col("_m.sizes").alias("size")
    )


def links(
    things: DataFrame | Sequence[DataFrame],
    held: Callable[[DataFrame], DataFrame],
    proof: Prepared,
    similarity: float,
    tile: int = TILE,
    sift: Prepared | None = None,
) -> DataFrame:
    """``(a, b)`` over hashes: proven links that connect all that share a key and pass ``proof``.

    ``things(hash, size, keys)`` may repeat a hash and is read once; given in parts, with other keys in each, the keys of one part
    are shuffled at a time.  ``held`` gives ``hash, held`` (binary) for a table of hashes.  Sizes that differ by more than
    ``1 - similarity`` of the larger are never alike.  ``proof`` and ``sift`` prepare the held values of many units and give a function
    from pairs (row, row, larger size) to the mask of those that are alike, or worth a proof.
    """
    parts = [cut_lineage(buckets(part, similarity, tile)) for part in ([things] if isinstance(things, DataFrame) else things)]
    found = parts[0]
    if len(parts) > 1:
        found = cut_lineage(reduce(DataFrame.unionAll, parts).dropDuplicates(["no", "key", "own"]))
        discard(*parts)
    wanted = cut_lineage(found.select(F.explode("hashes").alias("hash")).distinct())
    # shuffled in every round, so it is kept small
    texts = cut_lineage(held(wanted), compression="zstd")
    rows = found.agg(F.sum(F.size("hashes"))).first()[0] or 0
    rounds = max(1, min(ROUNDS, rows // ROUND_ROWS))

    def dealt(no: int) -> DataFrame:
        """The units of a round, each with what its members hold."""
        own = found.where(F.pmod(F.xxhash64("no", "key"), F.lit(rounds)) == no) if rounds > 1 else found
        full = units(own).join(texts, "hash").select("no", "key", "low", "high", "own", "hash", "size", "held")
        return full.repartition("no", "key", "low", "high").sortWithinPartitions("no", "key", "low", "high", "hash")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, table in whole_units(batches, UNIT_ROWS):
            low, high, own, hashes, size = (table.column(c).to_numpy() for c in ("low", "high", "own", "hash", "size"))
            text = table.column("held").to_pylist()
            parent = list(range(len(hashes)))
            worth, alike = sift(text) if sift else None, proof(text)

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            first = np.flatnonzero(np.diff(unit, prepend=-1))
            count, label, step = np.diff(np.append(first, len(unit))), np.arange(len(unit)), 0
            waiting, n_waiting = [], 0
            while len(first) or n_waiting:
                if len(first):
                    a, b = np.repeat(first + step, count - step - 1), expand(first + step + 1, count - step - 1)
                    longer = np.maximum(size[a], size[b])
                    go = (label[a] != label[b]) & (np.abs(size[a] - size[b]) <= (1.0 - similarity) * longer + 1e-9) & ((low[a] == high[a]) | (own[a] != own[b]))
                    a, b, longer = a[go], b[go], longer[go]
                    if worth is not None and len(a):
                        near = worth(a, b, longer)
                        a, b, longer = a[near], b[near], longer[near]
                    waiting.append((a, b, longer))
                    n_waiting += len(a)
                    step += 1
                if n_waiting >= PROOFS or n_waiting and (step == 1 or not len(first)):
                    a, b, longer = (np.concatenate(x) for x in zip(*waiting))
                    waiting, n_waiting = [], 0
                    yes = alike(a, b, longer)
                    for i, j in zip(a[yes].tolist(), b[yes].tolist()):
                        x, y = root(i), root(j)
                        parent[max(x, y)] = min(x, y)
                    label = np.array(parent)
                    while (label != label[label]).any():
                        label = label[label]
                if len(first):
                    starts = np.cumsum(count) - count
                    at = expand(first, count)
                    apart = np.minimum.reduceat(label[at], starts) != np.maximum.reduceat(label[at], starts)
                    more = apart & (count > step + 1)
                    first, count = first[more], count[more]
            linked = label != np.arange(len(label))
            yield record_batch(LINKS, [hashes[label[linked]], hashes[linked]])

    proven = [dealt(no).mapInArrow(search, LINKS) for no in range(rounds)]
    if rounds == 1:
        return proven[0]
    every = [cut_lineage(of_round) for of_round in proven]
    discard(texts, wanted, found)
    return reduce(DataFrame.unionAll, every)

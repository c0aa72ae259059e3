"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Equal fingerprints are folded first.  Fingerprints that differ in at most ``distance`` bits
agree in at least ``blocks - distance`` of ``blocks`` blocks, so they meet in a bucket of that
many exact blocks.  In a bucket they are sorted by Gray rank, which puts similar patterns next
to each other; groups of neighbours share bits, and an upper node holds the mask and pattern of
its group's shared bits.  A pair of nodes is dropped with all its members once the shared bits
alone differ too often, and taken as a whole once even the free bits could not part them.

Buckets are cut into tiles of bounded size, and every pair of tiles is a task unit of its own,
so no group of copies has to fit anywhere.  A unit reports only links that span its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut_lineage
from . import sieve
from .common import as_bytes, expand, map_text, record_batch
from .words import spaced_words

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 5
# sets of a Jaccard similarity of 0.8 share one of these keys but for one pair in 90,000
SHINGLES_PER_KEY = 3
SHINGLE_KEYS = 16
TILE = 4096
FAN_OUT = 8
PAIRS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 1 << 17
LINKS = "a bigint, b bigint"


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingles' hashes have it; no words: zero."""
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        text = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-size]]).tolist()
        shingles = [text[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 65536)):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a bigint; null and empty texts have fingerprint 0."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.array([fingerprint(spaced_words(t), size) for t in as_bytes(texts)], dtype=np.uint64)
            yield pa.array(values.view(np.int64), pa.int64())

    return docs.withColumn(into, run(F.col("text").cast("string")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Index:
    """Levels of nodes over sorted fingerprints; a node never spans two groups."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, fan_out: int = FAN_OUT):
        self.codes = codes
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        self.levels = []  # (first leaf, mask, pattern, first child) from the leaves' parents up
        bounds = np.arange(len(codes))
        owner = np.searchsorted(first, bounds, side="right") - 1
        while len(bounds) > len(first):
            begin = np.searchsorted(owner, np.arange(len(first)))
            inside = np.arange(len(bounds)) - begin[owner]
            child = np.flatnonzero(inside % fan_out == 0)
            bounds, owner = bounds[child], owner[child]
            both, some = np.bitwise_and.reduceat(codes, bounds), np.bitwise_or.reduceat(codes, bounds)
            mask = ~(both ^ some)
            self.levels.append((bounds, mask, both & mask, child))
        self.sizes = [len(codes)] + [len(x[0]) for x in self.levels]

    def links(self, distance: int, every: bool = False, at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf pairs that connect everything within ``distance``, or ``every`` such pair."""
        if not self.levels:
            return
        roots = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.levels), roots, roots)]
        while todo:  # depth first, so few pairs are held at a time
            level, a, b = todo.pop()
            if level == 0:
                near = np.bitwise_count(self.codes[a] ^ self.codes[b]) <= distance
                near &= a != b
                yield a[near], b[near]
                continue
            bounds, mask, pattern, child = self.levels[level - 1]
            shared = mask[a] & mask[b]
            differ = np.bitwise_count((pattern[a] ^ pattern[b]) & shared)
            whole = (differ + np.bitwise_count(~shared) <= distance) & (not every)
            if whole.any():
                yield from self._join(level, a[whole], b[whole])
            go = (differ <= distance) & ~whole
            a, b = a[go], b[go]
            stop = np.append(child[1:], self.sizes[level - 1])
            count_a, count_b = stop[a] - child[a], stop[b] - child[b]
            parts = self._parts(count_a * count_b, at_once)
            if len(parts) > 1:
                todo += [(level, a[part], b[part]) for part in parts]
                continue
            pair = np.repeat(np.arange(len(a)), count_a * count_b)
            inside = expand(np.zeros(len(a), dtype=np.int64), count_a * count_b)
            left = child[a][pair] + inside // count_b[pair]
            right = child[b][pair] + inside % count_b[pair]
            once = (a != b)[pair] | (left <= right)
            todo.append((level - 1, left[once], right[once]))

    @staticmethod
    def _parts(size: np.ndarray, at_once: int) -> list[np.ndarray]:
        if not len(size):
            return []
        block = (np.cumsum(size) - 1) // at_once
        return np.split(np.arange(len(size)), np.flatnonzero(np.diff(block)) + 1)

    def _join(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Link every leaf below both nodes to the first one."""
        bounds = self.levels[level - 1][0]
        stop = np.append(bounds[1:], len(self.codes))
        for node in (a, b):
            count = stop[node] - bounds[node]
            yield np.repeat(bounds[a], count), expand(bounds[node], count)


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while not np.array_equal(up := label[label], label):
                label = up
            if np.array_equal(before, label):
                break
    return label


def bucket_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """The bits that must agree, for each choice of ``blocks - distance`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _bucket_columns(code: str, blocks: int, distance: int):
    """One struct(no, key) for each choice of blocks that must agree."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in bucket_masks(blocks, distance)]
    return F.explode(F.array(*[F.struct(F.lit(n).alias("no"), F.col(code).bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(signed)]))


def meet(rows: DataFrame, code: str, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``no, key, low, high`` and the columns of ``rows``: rows dealt out and sorted by units of search.

    Any two rows whose codes differ in at most ``distance`` bits are together in some unit; a unit is
    a pair of tiles (``low``, ``high``) of a bucket.  Rows alone in all their buckets are gone.
    """
    cut = rows.withColumn("_k", _bucket_columns(code, blocks, distance)).select("_k.no", "_k.key", *rows.columns)
    sizes = cut.groupBy("no", "key").agg(F.count("*").alias("_n")).withColumn("_tiles", F.ceil(F.col("_n") / tile).cast("int"))
    if blocks - distance == 1:  # wide buckets: hardly any row is alone, so only the few large ones are looked up
        met = cut.join(sizes.where(F.col("_n") > tile), ["no", "key"], "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    else:
        met = cut.join(sizes.where("_n > 1"), ["no", "key"])
    salt = F.pmod(F.xxhash64(*rows.columns), F.col("_tiles")).cast("int")
    met = met.select("no", "key", *rows.columns, salt.alias("_s"), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_t"))
    units = met.select("no", "key", F.least("_s", "_t").alias("low"), F.greatest("_s", "_t").alias("high"), *rows.columns)
    return units.repartition("no", "key", "low", "high").sortWithinPartitions("no", "key", "low", "high")


def whole_units(batches: Iterator[pa.RecordBatch], at_once: int = ROWS_AT_ONCE) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Unit number and rows of complete units, many units at a time."""
    held: list[pa.RecordBatch] = []
    n = 0

    def numbered(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(4)])
        return np.concatenate([[0], np.cumsum((keys[:, :-1] != keys[:, 1:]).any(axis=0))])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= at_once:
            table = pa.Table.from_batches(held)
            unit = numbered(table)
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
            if cut:
                yield unit[:cut], table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n = table.num_rows - cut
    if n:
        table = pa.Table.from_batches(held)
        yield numbered(table), table


def near_links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``(a, b)``: links that connect all of ``distinct(fingerprint)`` within ``distance`` bits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, table in whole_units(batches):
            codes = table.column("fingerprint").to_numpy().astype(np.int64).view(np.uint64)
            by = np.lexsort((gray_rank(codes), unit))
            codes = codes[by]
            label = spanning(len(codes), Index(unit[by], codes).links(distance))
            linked = label != np.arange(len(label))
            yield record_batch(LINKS, [codes[label[linked]].view(np.int64), codes[linked].view(np.int64)])

    return meet(distinct.select("fingerprint"), "fingerprint", distance, blocks, tile).mapInArrow(search, LINKS).distinct()


def groups(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id that links of at most ``distance`` bits reach (null if all
    ids of the group are null).  Rows that repeat an id are each fingerprinted.
    """
    marked = cut_lineage(fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fingerprint"))
    distinct = cut_lineage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    links = cut_lineage(near_links(distinct.select("fingerprint"), distance, blocks, tile))
    reached = components(links)  # only fingerprints with links
    tagged = distinct.join(reached.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    tagged = cut_lineage(tagged.select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")))
    lowest = tagged.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_code = tagged.join(lowest, "component").select("fingerprint", "component_id")
    return marked.join(by_code, "fingerprint").select("doc_id", "fingerprint", "component_id")


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted different hashes of the runs of ``size`` words (of all words, if there are fewer)."""
    runs = [b" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], dtype=np.uint64))


def shingle_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, hash, component_id``: one row per row of ``docs(doc_id, text)``, grouped by Jaccard similarity of shingles.

    Texts with equal sets of shingles are folded (those without words are one set); others meet by keys of
    ``SHINGLES_PER_KEY`` smallest shingle hashes, and a link is proven by the sets themselves.
    ``component_id`` is as in ``groups``.
    """
    from .alike import links, min_keys

    schema = "doc_id bigint, hash bigint, size int, keys array<bigint>"

    def sets(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        found = [shingles(spaced_words(t), size) for t in as_bytes(texts)]
        return found, np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], dtype=np.uint64).view(np.int64)

    def mark(batch: pa.RecordBatch):
        found, hashes = sets(batch.column(1))
        sizes = np.array([len(s) for s in found])
        full, keys = np.flatnonzero(sizes), [[] for _ in found]
        if len(full):
            for i, k in zip(full, min_keys(np.concatenate(found), sizes[full], SHINGLES_PER_KEY, SHINGLE_KEYS, SEED)):
                keys[i] = np.unique(k)
        yield record_batch(schema, [batch.column(0), hashes, sizes.astype(np.int32), keys])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = cut_lineage(map_text(rows, "text", mark, schema))
    distinct = cut_lineage(marked.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("keys").alias("keys")))

    def held(wanted: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(sieve.build(wanted, "hash"))

        def read(batch: pa.RecordBatch):
            found, hashes = sets(batch.column(0))
            some = np.flatnonzero(shared.value.passes(hashes))
            yield record_batch("hash bigint, held binary", [hashes[some], [found[i].tobytes() for i in some]])

        found = map_text(rows.select("text"), "text", read, "hash bigint, held binary")
        return found.join(wanted, "hash", "left_semi").groupBy("hash").agg(F.first("held").alias("held"))

    def proof(sets: list[bytes]):
        held = [np.frombuffer(s, np.uint64) for s in sets]

        def alike(x: np.ndarray, y: np.ndarray) -> bool:
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both >= similarity * (len(x) + len(y) - both) - 1e-9

        return lambda a, b, longer: np.array([alike(held[i], held[j]) for i, j in zip(a.tolist(), b.tolist())], dtype=bool)

    reached = components(cut_lineage(links(distinct.select("hash", "size", "keys"), held, proof, similarity)))
    tagged = distinct.select("hash", "first_id").join(reached.withColumnRenamed("node", "hash"), "hash", "left")
    tagged = cut_lineage(tagged.select("hash", "first_id", F.coalesce("component", "hash").alias("component")))
    lowest = tagged.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = tagged.join(lowest, "component").select("hash", "component_id")
    return marked.select("doc_id", "hash").join(by_set, "hash").select("doc_id", "hash", "component_id")

"""Benchmark decontamination by a prefix-filtered set join on word shingles.

Windows of the benchmark (``window`` consecutive words; a shorter item is one window) are sets
of shingles of up to three words.  Shingles are ordered by how rare they are in all documents.
A document holds a window only if it holds its rarest shingle, so the prefix of length one is
enough for containment: the join of document shingles with the windows' rarest shingles gives
every candidate.  Position and length bounds drop candidates that would leave the document,
and the words of the rest are compared one by one.

The benchmark is a stated query set: it is taken in blocks of bounded size, each sent to the
tasks, and documents are read twice per block (frequencies, then the join).  Documents are
never shuffled and no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, as_bytes, expand, record_batch, slices
from .words import Vocabulary, plain_words

WINDOW = 13
SHINGLE = 3
# words of benchmark text in one block (bounds what is sent to the tasks)
BLOCK_WORDS = 2_000_000
# an id takes 21 bits, so three make an exact 63-bit code
BITS = 21
HITS = "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, items: array<string>>"


class Flat:
    """Texts as one array of word numbers; ``doc_end[i]`` ends the text that holds word ``i``."""

    def __init__(self, texts: list[bytes], vocabulary: Vocabulary):
        lists = [plain_words(t) for t in texts]
        self.sizes = np.array([len(x) for x in lists], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([i for x in lists for i in vocabulary.ids(x)], dtype=np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.sizes)
        self.end = (self.starts + self.sizes)[self.row]

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and codes of the shingles made of known words only, within one text."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        code, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(size):
            part = self.ids[k : k + n]
            code = (code << BITS) | part
            known &= part > 0
        at = np.flatnonzero(known & (np.arange(n) + size <= self.end[:n]))
        return at, code[at]


class Windows:
    """Distinct windows of one block of items, padded with 0, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        split = [(item, plain_words(text)) for item, text in items]
        self.vocabulary = Vocabulary(w for _, words in split for w in words)
        found: dict[tuple[int, ...], list[int]] = {}
        self.items = sorted({item for item, words in split if words})
        number = {item: i for i, item in enumerate(self.items)}
        for item, words in split:
            ids = self.vocabulary.ids(words)
            for at in range(max(len(ids) - window + 1, 1) if ids else 0):
                held = found.setdefault(tuple(ids[at : at + window]), [])
                if not held or held[-1] != number[item]:
                    held.append(number[item])
        self.words = np.zeros((len(found), window), dtype=np.int64)
        self.length = np.array([len(w) for w in found], dtype=np.int64)
        for i, w in enumerate(found):
            self.words[i, : len(w)] = w
        counts = np.array([len(v) for v in found.values()], dtype=np.int64)
        self.item_first = np.cumsum(counts) - counts
        self.item_count = counts
        self.item_of = np.array([i for v in found.values() for i in v], dtype=np.int64)

    def shingle_size(self) -> np.ndarray:
        return np.minimum(self.length, SHINGLE)

    def codes(self, size: int) -> np.ndarray:
        """Every distinct shingle code of the windows that use shingles of ``size`` words."""
        rows = self.words[self.shingle_size() == size]
        return np.unique(np.concatenate([_code(rows[:, k : k + size])[_full(rows, k, size)] for k in range(self.words.shape[1] - size + 1)] or [np.zeros(0, dtype=np.int64)]))

    def order(self, frequency: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Pick every window's rarest shingle (leftmost of equals): ``prefix[size]`` = (sorted codes, window, position)."""
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = self.shingle_size()
        for size in range(1, SHINGLE + 1):
            which = np.flatnonzero(sizes == size)
            if not len(which):
                continue
            codes, counts = frequency.get(size, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
            best = np.full(len(which), np.iinfo(np.int64).max)
            code = np.zeros(len(which), dtype=np.int64)
            place = np.zeros(len(which), dtype=np.int64)
            for k in range(self.words.shape[1] - size + 1):
                full = _full(self.words[which], k, size)
                here = _code(self.words[which, k : k + size])
                seen = _lookup(codes, counts, here)
                better = full & (seen < best)
                best[better], code[better], place[better] = seen[better], here[better], k
            by = np.argsort(code, kind="stable")
            self.prefix[size] = (code[by], which[by], place[by])

    def find(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        """Start position and window of every occurrence in the texts."""
        starts, windows = [], []
        for size, (codes, which, place) in self.prefix.items():
            at, code = flat.shingles(size)
            low, high = np.searchsorted(codes, code, side="left"), np.searchsorted(codes, code, side="right")
            counts = high - low
            if not counts.any():
                continue
            at, low, counts = at[counts > 0], low[counts > 0], counts[counts > 0]
            joined = expand(low, counts)
            where = np.repeat(at, counts)
            window, start = which[joined], where - place[joined]
            # position and length bounds: the window must lie inside the text of its shingle
            first = flat.starts[flat.row[where]]
            fits = (start >= first) & (start + self.length[window] <= flat.end[where])
            window, start = window[fits], start[fits]
            same = np.ones(len(window), dtype=bool)
            for k in range(self.words.shape[1]):
                wanted = self.words[window, k]
                same &= (wanted == 0) | (flat.ids[np.minimum(start + k, len(flat.ids) - 1)] == wanted)
            starts.append(start[same])
            windows.append(window[same])
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(starts), np.concatenate(windows)


def _code(words: np.ndarray) -> np.ndarray:
    code = np.zeros(len(words), dtype=np.int64)
    for k in range(words.shape[1]):
        code = (code << BITS) | words[:, k]
    return code


def _full(rows: np.ndarray, k: int, size: int) -> np.ndarray:
    return (rows[:, k : k + size] > 0).all(axis=1)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded text size; each block is read on its own."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    n = int(total // block_words) + 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(n))
    for k in range(n):
        yield [(r[0], r[1].encode()) for r in sorted(items.where(block == k).collect())]


def frequencies(docs: DataFrame, windows: Windows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each benchmark shingle occurs in all documents."""
    wanted = {size: codes for size in range(1, SHINGLE + 1) if len(codes := windows.codes(size))}
    shared = docs.sparkSession.sparkContext.broadcast((windows.vocabulary, wanted))
    schema = "size int, code bigint, n bigint"

    def count(batches):
        vocabulary, codes = shared.value
        held = {size: np.zeros(len(c), dtype=np.int64) for size, c in codes.items()}

        def add(batch):
            flat = Flat(as_bytes(batch.column(0)), vocabulary)
            for size, c in codes.items():
                _, code = flat.shingles(size)
                at = np.minimum(np.searchsorted(c, code), len(c) - 1)
                held[size] += np.bincount(at[c[at] == code], minlength=len(c))

        for batch in batches:
            for part in slices(batch, batch.schema.names[0], CHUNK_BYTES):
                add(part)
        for size, c in codes.items():
            has = held[size] > 0
            yield record_batch(schema, [np.full(int(has.sum()), size, dtype=np.int32), c[has], held[size][has]])

    table = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema).groupBy("size", "code").agg(F.sum("n").alias("n")).toArrow()
    size, code, n = (table.column(c).to_numpy() for c in ("size", "code", "n"))
    out = {}
    for s in wanted:
        by = np.argsort(code[size == s])
        out[s] = (code[size == s][by], n[size == s][by])
    return out


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, into: str = "hits", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``into(n_words, starts, ends, items)``; one row in, one row out.

    ``starts`` and ``ends`` are the maximal runs of hit words (from 0, end not included), ``items``
    the sorted ids (as text) of the benchmark items with occurring windows.  Null texts have no
    words; items without words have no window; a null item id counts as the empty text.
    """
    spark = docs.sparkSession
    marked = docs
    for number, items in enumerate(_blocks(benchmark, block_words)):
        windows = Windows(items, window)
        windows.order(frequencies(docs, windows))
        shared = spark.sparkContext.broadcast(windows)
        column = _finder(shared)(F.col("text").cast("string"))
        marked = marked.withColumn(into, column) if number == 0 else marked.withColumn(into, _merge(F.col(into), column))
    return marked


def _finder(shared):
    @F.arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows: Windows = shared.value
        for texts in batches:
            parts = []
            held = pa.record_batch([texts], names=["text"])
            for part in slices(held, "text"):
                parts.append(_hits(windows, as_bytes(part.column(0))))
            yield pa.concat_arrays(parts) if parts else pa.array([], HIT_TYPE)

    return find


HIT_TYPE = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _hits(windows: Windows, texts: list[bytes]) -> pa.Array:
    flat = Flat(texts, windows.vocabulary)
    start, window = windows.find(flat)
    out = [{"n_words": int(n), "starts": [], "ends": [], "items": []} for n in flat.sizes]
    if len(start):
        n = len(flat.ids)
        cover = np.bincount(start, minlength=n + 1) - np.bincount(start + windows.length[window], minlength=n + 1)
        hit = np.cumsum(cover[:n]) > 0
        # a run ends where hits stop or the text does
        begins = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & (np.arange(len(hit)) != flat.starts[flat.row])))
        stops = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & (np.arange(len(hit)) + 1 != flat.end))) + 1
        for b, e in zip(begins, stops):
            row = flat.row[b]
            out[row]["starts"].append(int(b - flat.starts[row]))
            out[row]["ends"].append(int(e - flat.starts[row]))
        counts = windows.item_count[window]
        pairs = np.unique(np.stack([np.repeat(flat.row[start], counts), windows.item_of[expand(windows.item_first[window], counts)]]), axis=1)
        for row, item in pairs.T:
            out[row]["items"].append(windows.items[item])
    return pa.array(out, HIT_TYPE)


def _merge(a, b):
    """Hits of two blocks: runs joined where they touch, items united."""
    runs = lambda h: F.zip_with(h["starts"], h["ends"], lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    first = F.array_sort(F.concat(runs(a), runs(b)))
    joined = F.aggregate(
        first,
        F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)"),
        lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= r["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], r["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(r))),
    )
    return F.struct(a["n_words"].alias("n_words"), joined["s"].alias("starts"), joined["e"].alias("ends"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"))


def contaminated(hits, one_in: int = 20):
    """The rule: some word is hit, and so is at least one word in ``one_in``."""
    n_hit = hit_words(hits)
    return (n_hit > 0) & (one_in * n_hit >= hits["n_words"])


def hit_words(hits):
    """Number of hit words."""
    return F.aggregate(F.zip_with(hits["starts"], hits["ends"], lambda s, e: e - s), F.lit(0).cast("bigint"), lambda acc, n: acc + n)

"""Exact substring deduplication on suffix arrays, over texts as bytes.

A string of ``length`` bytes is repeated if it starts anywhere else as well.  Every window of
that length is led by its smallest hashed ``anchor`` bytes, so equal windows have the same
leader at the same place, and the windows of one leader are a segment of neighbours.  Segments
meet by leader: a leader that occurs once cannot lead a repeated window and its segment is
never moved.  Equal segments are folded with their number.

What is left is sorted in shards: all different segments of a leader are in one shard, whose
suffix array is built by induced sorting (``suffix_array``); a window is repeated if it agrees
over ``length`` bytes with a neighbour in the array (permuted common prefixes), or its segment
was folded.  A leader with more segments than a shard may hold is cut by window instead: its
windows are counted by a 128-bit hash (the exact way for hot leaders).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import sieve
from .common import as_bytes, free_name, mixed, record_batch, slices
from .suffix_array import common_prefixes, suffix_array

LENGTH = 200
ANCHOR = 64
# text looked at together in a task (its arrays should stay in a core's cache); segments sorted together in a shard
CHUNK_BYTES = 512 << 10
SHARD_BYTES = 2 << 20
SPANS = "doc_id bigint, first bigint, n int, leader bigint, hash bigint"
PIECES = "doc_id bigint, first bigint, data binary"
MARKS = "leader bigint, hash bigint, a int, b int"
STEP = np.uint64(0x9E3779B97F4A7C15)


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def leaders(data: np.ndarray, doc_end: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of joined texts: first window, number of windows and hash of the leader.

    ``doc_end[i]`` ends the text of byte ``i``; windows that leave their text do not count.
    """
    nothing = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return nothing, nothing, np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        value, width = BYTE_VALUES[data], 1
        while width < anchor:  # anchor is a power of two
            value = value[:-width] * mixed(np.array([width], dtype=np.uint64) * STEP + np.uint64(1)) + value[width:]
            width *= 2
    value = mixed(value)
    n = len(value)
    # smallest hash first; of equal ones the rightmost leads
    ranked = (value >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    size, width = length - anchor + 1, 1
    while width * 2 <= size:
        ranked = np.minimum(ranked[:-width], ranked[width:])
        width *= 2
    if size > width:
        ranked = np.minimum(ranked[: len(ranked) - (size - width)], ranked[size - width :])
    lead = (np.uint64(0xFFFFFFFF) - (ranked & np.uint64(0xFFFFFFFF))).astype(np.int64)
    at = np.arange(len(lead))
    inside = at + length <= doc_end[: len(lead)]
    lead = np.where(inside, lead, -1)
    change = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (doc_end[1 : len(lead)] != doc_end[: len(lead) - 1])]))
    count = np.diff(np.append(change, len(lead)))
    real = lead[change] >= 0
    first, count = change[real], count[real]
    return first, count, value[lead[first]]


class Joined:
    """A batch of texts as one byte array, with its segments."""

    def __init__(self, batch: pa.RecordBatch, length: int, anchor: int):
        texts = as_bytes(batch.column(1))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        ends = np.cumsum(sizes)
        self.first, self.count, leader = leaders(self.data, np.repeat(ends, sizes), length, anchor)
        self.leader = leader.view(np.int64)
        self.row = np.searchsorted(ends, self.first, side="right")
        self.inside = self.first - (ends - sizes)[self.row]
        self.ids = batch.column(0).take(pa.array(self.row))

    def bytes_of(self, i: int, length: int) -> bytes:
        return self.raw[self.first[i] : self.first[i] + self.count[i] + length - 1]


def places(ids: pa.Array, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of the byte ``first`` of the document ``ids``, row by row."""
    with np.errstate(over="ignore"):
        ids = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).view(np.uint64)
        return mixed(mixed(ids) + first.astype(np.uint64)).view(np.int64)


def _over(docs: DataFrame, fn, schema: str, length: int, anchor: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                yield from fn(Joined(part, length, anchor))

    return rows.mapInArrow(run, schema)


def segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``doc_id, first, n, leader, hash`` of every segment."""

    def emit(joined: Joined):
        digest = xxhash.xxh3_64_intdigest
        hashes = np.array([digest(joined.bytes_of(i, length)) for i in range(len(joined.first))], dtype=np.uint64).view(np.int64)
        yield record_batch(SPANS, [joined.ids, joined.inside, joined.count.astype(np.int32), joined.leader, hashes])

    return _over(docs, emit, SPANS, length, anchor)


def that_pass(rows: DataFrame, key: str, wanted: sieve.Sieve) -> DataFrame:
    """``rows`` whose ``key`` passes the sieve."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    @F.arrow_udf("boolean")
    def passes(keys: pa.Array) -> pa.Array:
        return pa.array(shared.value.passes(keys.to_numpy(zero_copy_only=False)))

    return rows.where(passes(key))


def texts_of(docs: DataFrame, wanted: sieve.Sieve, length: int, anchor: int) -> DataFrame:
    """``doc_id, first, data``: bytes of the segments whose place passes the sieve."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def emit(joined: Joined):
        take = np.flatnonzero(shared.value.passes(places(joined.ids, joined.inside)))
        yield record_batch(PIECES, [joined.ids.take(pa.array(take)), joined.inside[take], [joined.bytes_of(i, length) for i in take.tolist()]])

    return _over(docs, emit, PIECES, length, anchor)


def mark_shard(pieces: list[bytes], length: int) -> list[tuple[int, np.ndarray]]:
    """Repeated windows among different pieces: ``(piece, window starts)`` from one suffix array."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    # byte b becomes b + 2; 1 parts the pieces, 0 ends the text
    text = np.frombuffer(b"".join(p + b"\0" for p in pieces), dtype=np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    room = np.repeat(ends, sizes + 1) - np.arange(len(text))
    text, room = np.append(text, 0), np.append(room, 0)
    before, agree = common_prefixes(np.where(text > 1, text - 2, 0), suffix_array(text, 258), room)
    at = np.flatnonzero(agree >= length)
    hit = np.zeros(len(text), dtype=bool)
    hit[at] = True
    hit[before[at]] = True
    hits = np.flatnonzero(hit)
    piece = np.searchsorted(ends, hits)
    starts = hits - (ends - sizes)[piece]
    cuts = np.flatnonzero(np.diff(piece)) + 1
    return [(int(p[0]), s) for p, s in zip(np.split(piece, cuts), np.split(starts, cuts)) if len(p)]


def _runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.append(cut, len(starts) - 1)] + 1).tolist()


def _sorted_marks(rows: DataFrame, length: int) -> DataFrame:
    """``leader, hash, a, b``: runs [a, b) of repeated windows, found in shards of whole leaders."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for leader, hash_, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size >= SHARD_BYTES and held[-1][0] != leader:
                    yield from shard(held)
                    held, size = [], 0
                held.append((leader, hash_, data))
                size += len(data)
        if held:
            yield from shard(held)

    def shard(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for piece, starts in mark_shard([h[2] for h in held], length):
            a, b = _runs(starts)
            for column, values in zip(out, ([held[piece][0]] * len(a), [held[piece][1]] * len(a), a, b)):
                column += values
        yield record_batch(MARKS, list(out))

    return rows.select("leader", "hash", "data").repartition("leader").sortWithinPartitions("leader", "hash").mapInArrow(search, MARKS)


def _counted_marks(rows: DataFrame, length: int) -> DataFrame:
    """The same for hot leaders: windows counted by their own hash, so no leader is a group."""
    schema = "window binary, leader bigint, hash bigint, a int"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leader, hash_, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = len(data) - length + 1
                yield record_batch(schema, [[xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)], [leader] * n, [hash_] * n, np.arange(n, dtype=np.int32)])

    windows = rows.select("leader", "hash", "data").mapInArrow(explode, schema)
    often = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return windows.join(often, "window").select("leader", "hash", "a", (F.col("a") + 1).alias("b"))


@F.arrow_udf(T.LongType())
def _place(ids: pa.Array, first: pa.Array) -> pa.Array:
    return pa.array(places(ids, first.to_numpy(zero_copy_only=False)))


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, starts, ends``: runs of windows [start, end) that are repeated, for documents that have any."""
    every = cut_lineage(segments(docs, length, anchor))
    leads = cut_lineage(every.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader"))
    found = cut_lineage(that_pass(every, "leader", sieve.build(leads, "leader")).join(leads, "leader", "left_semi"))
    folded = cut_lineage(found.groupBy("leader", "hash").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.min(F.struct("doc_id", "first")).alias("at")))
    # leaders with several different segments need the suffix array
    per = folded.groupBy("leader").agg(F.count("*").alias("_kinds"), F.sum(F.col("n") + length - 1).alias("_bytes")).where("_kinds > 1")
    several = cut_lineage(folded.join(per, "leader").select("leader", "hash", "_bytes", "at.doc_id", "at.first", _place("at.doc_id", "at.first").alias("place")))
    pieces = texts_of(docs, sieve.build(several, "place"), length, anchor)
    same = F.col("s.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("s.first") == F.col("p.first"))
    rows = several.alias("s").join(pieces.alias("p"), same).select("s.leader", "s.hash", "s._bytes", "p.data")
    rows = cut_lineage(rows.dropDuplicates(["leader", "hash"]))
    marks = _sorted_marks(rows.where(F.col("_bytes") <= shard_bytes), length).unionAll(_counted_marks(rows.where(F.col("_bytes") > shard_bytes), length))
    by_segment = marks.groupBy("leader", "hash").agg(F.collect_list(F.struct("a", "b")).alias("runs"))  # at most one per window of a segment
    whole = folded.where("times > 1").select("leader", "hash", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("runs"))
    known = whole.unionAll(by_segment.join(whole.select("leader", "hash"), ["leader", "hash"], "left_anti"))
    placed = found.join(cut_lineage(known), ["leader", "hash"]).select("doc_id", "first", F.explode("runs").alias("r"))
    run = F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b"))
    return placed.groupBy("doc_id").agg(F.array_sort(F.collect_set(run)).alias("runs")).select("doc_id", F.col("runs.a").alias("starts"), F.col("runs.b").alias("ends"))


RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])))])
RESULT_ARROW = pa.struct([("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def deduplicate(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, into: str = "deduplicated") -> DataFrame:
    """``docs`` with ``into(n_bytes, kept, spans)``: the bytes left, and the maximal removed runs [first, last).

    Every byte covered by a repeated window of the input goes.  A null text is empty.  Rows with the
    same ``doc_id`` are taken for copies of one document.
    """
    key, first, stop = (free_name(docs, c) for c in ("_id", "_starts", "_ends"))
    runs = repeated(docs, length, anchor, shard_bytes).select(F.col("doc_id").alias(key), F.col("starts").alias(first), F.col("ends").alias(stop))

    @F.arrow_udf(RESULT)
    def remove(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for t, a, b in zip(as_bytes(text), starts.to_pylist(), ends.to_pylist()):
            spans: list[dict] = []
            for first, last in zip(a or [], b or []):
                last += length - 1
                if spans and first <= spans[-1]["last"]:
                    spans[-1]["last"] = max(spans[-1]["last"], last)
                else:
                    spans.append({"first": first, "last": last})
            edges = [0, *(x for s in spans for x in (s["first"], s["last"])), len(t)]
            out.append({"n_bytes": len(t), "kept": b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2])), "spans": spans})
        return pa.array(out, RESULT_ARROW)

    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col(key)), "left")
    return joined.select(*[c for c in docs.columns if c != into], remove(F.col("text").cast("string"), F.col(first), F.col(stop)).alias(into))

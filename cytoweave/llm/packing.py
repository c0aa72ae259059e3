"""Best-fit packing of token pieces into sequences of a fixed length.

Which lengths share a sequence is decided on the histogram of lengths alone, at most
``capacity`` numbers whatever the number of documents.  The configuration linear program over
it is solved by multiplicative weights: every length has a price, a knapsack dynamic program
finds the most valuable configuration, and the prices of what it covers fall.  The fractional
solution is rounded down; what is left is priced again, and what no pass places is placed best
fit, longest first, with equal pieces counted.  The plan never needs more sequences than best fit
alone.

Pieces find their place by their rank among the pieces of their length, so nothing is
gathered: ranks are counted inside each task and shifted by the counts of earlier tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import expand, list_array, map_text, record_batch
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
SWEEPS = 8
STEP = 0.25
# lengths that share one pricing
BLOCK = 64
# first prices grow a little faster than the lengths: of equally full sequences those of few long pieces come first
BEND = 1.05
# passes end when rounding leaves more than this share
LEAST_PROGRESS = 0.5
PIECES = "doc_id bigint, piece int, start bigint, length bigint, part int, rank bigint, ids array<int>"


# --- the plan: driver-side numbers of at most `capacity` lengths ----------------------------------


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """For every room the length (by position) that the most valuable filling takes next; -1: leave one free."""
    value = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        k = fits[room]
        if k:
            gain = value[room - lengths[:k]] + prices[:k]
            at = int(gain.argmax())
            if gain[at] > value[room] + 1e-15:
                value[room], took[room] = gain[at], at
    return took


def configuration(first: int, took: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The best configuration that holds length ``first``: ``((position, times), ...)``."""
    held = {first: 1}
    room = capacity - int(lengths[first])
    while room > 0:
        at = int(took[room])
        if at < 0:
            room -= 1
        else:
            held[at] = held.get(at, 0) + 1
            room -= int(lengths[at])
    return tuple(sorted(held.items()))


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, sweeps: int, step: float) -> dict[tuple, float]:
    """``{configuration: amount}`` that covers ``demand`` (nearly), by multiplicative weights.

    A sweep visits every length once, in blocks that share one pricing: the best configuration
    with that length is bought until its scarcest length has a ``step`` of its demand, and
    prices fall with what was covered.
    """
    prices = (lengths / capacity) ** BEND
    covered = np.zeros(len(lengths))
    amounts: dict[tuple, float] = {}
    for _ in range(sweeps):
        todo = np.argsort(covered - lengths * 1e-9, kind="stable")
        todo = todo[covered[todo] < 1.0]
        if not len(todo):
            break
        for block in np.array_split(todo, -(-len(todo) // BLOCK)):
            took = knapsack(lengths, prices, capacity)
            for first in block[::-1]:
                shape = configuration(int(first), took, lengths, capacity)
                at, per = np.array(shape).T
                amount = step * float((demand[at] / per).min())
                amounts[shape] = amounts.get(shape, 0.0) + amount
                share = per * amount / demand[at]
                covered[at] += share
                prices[at] *= np.exp(-share)
    return amounts


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], int]:
    """``{configuration: times}``: longest first, each into the fullest sequence with room.

    Equal sequences are one entry with a count, and equal pieces are placed together: a piece that
    fits twice into the fullest sequence goes there twice.  So work grows with the lengths, not with
    the pieces.
    """
    open_at: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    in_use = np.zeros(capacity + 1, dtype=bool)
    for at in np.argsort(-lengths, kind="stable"):
        size, todo = int(lengths[at]), int(counts[at])
        while todo:
            rooms = np.flatnonzero(in_use[size:])
            if len(rooms):
                room = size + int(rooms[0])
                shape, there = open_at[room].popitem()
            else:
                room, shape, there = capacity, (), todo
            per = min(room // size, todo)
            times = min(there, todo // per)
            if there > times and room < capacity:
                open_at[room][shape] = there - times
            in_use[room] = bool(open_at[room])
            rest, held = room - per * size, (*shape, (int(at), per))
            open_at[rest][held] = open_at[rest].get(held, 0) + times
            in_use[rest] = True
            todo -= per * times
    return {shape: times for at_room in open_at for shape, times in at_room.items()}


def plan(histogram: dict[int, int], capacity: int = CAPACITY, sweeps: int = SWEEPS, step: float = STEP) -> list[tuple[dict[int, int], int]]:
    """``[(configuration, times)]`` that holds every piece of ``histogram`` (length -> count) exactly once.

    Each pass solves the linear program for what the rounding of the last one left, until rounding
    leaves nearly all.  Rounded passes are kept as long as they help: the plan is the shortest of those that
    place the rest after some number of passes best fit, so it is never longer than best fit alone.
    """
    lengths = np.array(sorted(n for n in histogram if histogram[n]), dtype=np.int64)
    left = np.array([histogram[n] for n in lengths], dtype=np.int64)
    bought: list[tuple[tuple, int]] = []
    best = list(best_fit(lengths, left, capacity).items())
    while left.sum() > 0:
        here = np.flatnonzero(left)
        before = left.sum()
        amounts = fractional(lengths[here], left[here].astype(float), capacity, sweeps, step)
        for shape, amount in sorted(amounts.items(), key=lambda x: (-sum(lengths[here[i]] * n for i, n in x[0]), x[0])):
            at, per = here[[i for i, _ in shape]], np.array([n for _, n in shape])
            times = min(int(amount + 1e-9), int((left[at] // per).min()))
            if times > 0:
                left[at] -= per * times
                bought.append((tuple(zip(at.tolist(), per.tolist())), times))
        whole = bought + list(best_fit(lengths, left, capacity).items())
        if sum(times for _, times in whole) <= sum(times for _, times in best):
            best = whole
        if left.sum() > LEAST_PROGRESS * before:
            break
    return [({int(lengths[at]): per for at, per in shape}, times) for shape, times in best]


class Places:
    """The plan as a look-up from (length, rank) to (sequence, offset)."""

    def __init__(self, configurations: list[tuple[dict[int, int], int]]):
        next_rank: dict[int, int] = {}
        rows, base = [], 0
        for shape, times in configurations:
            offset = 0
            for length, per in sorted(shape.items(), reverse=True):
                first = next_rank.get(length, 0)
                rows.append((length, first, base, per, offset))
                next_rank[length] = first + per * times
                offset += length * per
            base += times
        rows.sort()
        self.length, self.first, self.base, self.per, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        self.keys = self.length * (1 << 48) + self.first
        self.n_sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length * (1 << 48) + rank, side="right") - 1
        inside = rank - self.first[at]
        return self.base[at] + inside // self.per[at], self.offset[at] + inside % self.per[at] * length


# --- pieces and their places: Spark ------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)``: ``doc_id, piece, start, length, part, rank, ids``.

    Every document is its ids and ``end_id`` (a null or empty text: just that), cut only if longer
    than ``capacity``.  ``rank`` counts the pieces of one length inside ``part`` (the task); rows
    with the same ``doc_id`` are documents of their own.  The table is written to the shared
    folder: ranks and ids are then the same for all later readers.
    """

    def cut(batch: pa.RecordBatch):
        ranks = _ranks(capacity)
        ids, sizes = encoder(tokenizer).encode(batch.column(1))
        ids = np.insert(ids, np.cumsum(sizes), end_id)
        sizes = sizes + 1
        n_pieces = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), n_pieces)
        piece = expand(np.zeros(len(sizes), dtype=np.int64), n_pieces)
        start = piece * capacity
        length = np.minimum(sizes[row] - start, capacity)
        order = np.argsort(length, kind="stable")
        sorted_length = length[order]
        first = np.searchsorted(sorted_length, sorted_length, side="left")
        rank = np.empty(len(length), dtype=np.int64)
        rank[order] = np.arange(len(length)) - first + ranks[sorted_length]
        ranks += np.bincount(length, minlength=capacity + 1)
        part = np.full(len(row), TaskContext.get().partitionId(), dtype=np.int32)
        yield record_batch(PIECES, [batch.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, part, rank, list_array(ids, length, pa.int32())])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch_path(docs.sparkSession, "pieces")
    map_text(rows, "text", cut, PIECES).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(PIECES).parquet(path)


_held: dict[int, np.ndarray] = {}


def _ranks(capacity: int) -> np.ndarray:
    """Counters of the running task; another task (or attempt) starts anew."""
    attempt = TaskContext.get().taskAttemptId()
    if attempt not in _held:
        _held.clear()
        _held[attempt] = np.zeros(capacity + 1, dtype=np.int64)
    return _held[attempt]


def pack(cut: DataFrame, capacity: int = CAPACITY, sweeps: int = SWEEPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0) and ``offset`` (gapless from 0 in each sequence)."""
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint")).alias("_shift"))
    # at most `capacity` rows, whatever the input
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    places = cut.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity, sweeps)))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = places.value.find(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["sequence_id", "offset"])

    numbered = cut.join(shifts, ["length", "part"]).withColumn("_at", place(F.col("length"), F.col("rank") + F.col("_shift")))
    return numbered.select(*cut.columns, "_at.sequence_id", "_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the sequences themselves (each at most ``capacity`` ids, so groups are small)."""
    items = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return items.select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"))

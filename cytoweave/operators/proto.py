"""Prototypes: scores, nearest assignment, labels and geometry.

Prototypes are model parameters (hundreds of rows); :func:`bounded_matrix` proves
that before they are sent to every task.  A larger table goes through the tile
joins instead, with the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as V
from ..functions.bounds import bounded_matrix
from .neighbors import knn_graph, knn_join
from .rank import top_k
from .tiles import pack, pair_within, tile_map, unpack

BLOCK = 1 << 20  # score cells computed at once inside a task


def _block_scores(x: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return x @ p.T
    d = np.sqrt(V.cross_l2sq(x, p))
    # a row sitting on a prototype: rounding of the expanded form would show
    near = d < 1e-6
    if near.any():
        r, c = np.nonzero(near)
        d[r, c] = np.sqrt(((x[r] - p[c]) ** 2).sum(1))
    return d


def score_arrays(cells: DataFrame, protos: DataFrame, metric: str = "dot", out: str = "s") -> DataFrame:
    """Add ``out``: scores against every prototype in ``proto_id`` order.

    ``metric``: ``dot`` or ``l2``.
    """
    bounded = bounded_matrix(protos, "proto_id", "vec")
    if bounded is None:
        long = _scores_tiled(cells.select("cell_id", "vec"), protos, metric)
        arrays = long.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("proto_id", "s"))).alias("_l"))
        return cells.join(arrays, "cell_id").withColumn(out, F.transform("_l", lambda e: e["s"])).drop("_l")
    _, p = bounded

    def scores(col: pa.Array) -> pa.Array:
        x = V.matrix(col)
        return V.row_lists(_block_scores(x, p, metric) if len(x) else np.zeros((0, len(p))))

    return cells.withColumn(out, F.arrow_udf(scores, T.ArrayType(T.DoubleType()))("vec"))


def pair_scores(cells: DataFrame, protos: DataFrame, metric: str = "dot", keep: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Long form: one row per (cell, prototype), the requested result itself."""
    bounded = bounded_matrix(protos, "proto_id", "vec")
    if bounded is None:
        long = _scores_tiled(cells.select("cell_id", "vec"), protos, metric)
        extra = [c for c in keep if c != "cell_id"]
        return long.join(cells.select("cell_id", *extra), "cell_id") if extra else long
    ids = [int(i) for i in bounded[0]]
    scored = score_arrays(cells, protos, metric)
    return scored.select(*keep, F.posexplode("s").alias("_i", "s")).select(
        *keep, F.element_at(F.lit(ids), F.col("_i") + 1).cast("int").alias("proto_id"), "s"
    )


def _first_k(proto: np.ndarray, cell: np.ndarray, s: np.ndarray, k: int, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of triples, the k of every prototype with the smallest ``sign * s``, ties by cell id."""
    order = np.lexsort((cell, sign * s, proto))
    proto, cell, s = proto[order], cell[order], s[order]
    start = np.flatnonzero(np.diff(proto, prepend=proto[0] - 1)) if len(proto) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(proto)) - np.repeat(start, np.diff(np.append(start, len(proto))))
    keep = place < k
    return proto[keep], cell[keep], s[keep]


def _candidates(cell: np.ndarray, s: np.ndarray, k: int, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples of a score block that can be among the k of their prototype, ties at the border included."""
    if len(s) > k:
        border = np.partition(sign * s, k - 1, axis=0)[k - 1]
        row, column = np.nonzero(sign * s <= border)
    else:
        row, column = (i.reshape(-1) for i in np.indices(s.shape))
    return _first_k(column, cell[row], s[row, column], k, sign)


def top_cells(cells: DataFrame, protos: DataFrame, k: int, metric: str = "dot") -> DataFrame:
    """``(proto_id, cell_id, s, rank)``: the k most similar (``dot``) or nearest (``l2``) cells of every prototype, ties by cell id.

    Every task keeps k cells per prototype while it scores its rows, so what leaves it does not grow with them: n x K rows
    never exist.  More prototypes than may go to the tasks are cut into tiles, and each pair of tiles is reduced the same way.
    """
    sign = -1 if metric == "dot" else 1
    schema = "proto_id int, cell_id bigint, s double"
    bounded = bounded_matrix(protos, "proto_id", "vec")
    names = ["proto_id", "cell_id", "s"]

    def told(ids, best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[best[0]].astype(np.int32)), pa.array(best[1], pa.int64()), pa.array(best[2])], names=names)

    if bounded is None:
        left = pack(cells.select("cell_id", "vec"), [])
        right = pack(protos.select(F.col("proto_id").cast("bigint").alias("cell_id"), "vec"), [])

        def kernel(row: dict) -> pa.RecordBatch:
            a, x = unpack(row["rows"])
            b, p = unpack(row["other"])
            return told(b, _candidates(a, _block_scores(x, p, metric), k, sign))

        found = tile_map(pair_within(left, right, [], []).select("rows", "other"), kernel, schema)
    else:
        ids, p = bounded

        def run(batches):
            best = None
            step = max(1, BLOCK // max(1, len(p)))
            for batch in batches:
                cell, x = batch.column("cell_id").to_numpy(), V.matrix(batch.column("vec"))
                for i in range(0, len(x), step):
                    new = _candidates(cell[i : i + step], _block_scores(x[i : i + step], p, metric), k, sign)
                    best = new if best is None else _first_k(*(np.concatenate(c) for c in zip(best, new)), k, sign)
            if best is not None and len(ids):
                yield told(ids, best)

        found = cells.select("cell_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, schema)
    return top_k(found, ["proto_id"], [F.desc("s") if metric == "dot" else F.asc("s"), F.asc("cell_id")], k)


def _scores_tiled(cells: DataFrame, protos: DataFrame, metric: str) -> DataFrame:
    left = pack(cells, [])
    right = pack(protos.select(F.col("proto_id").cast("bigint").alias("cell_id"), "vec"), [])

    def kernel(row: dict) -> pa.RecordBatch:
        a, x = unpack(row["rows"])
        b, p = unpack(row["other"])
        s = _block_scores(x, p, metric)
        return pa.record_batch(
            [pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a)).astype(np.int32)), pa.array(s.reshape(-1))],
            names=["cell_id", "proto_id", "s"],
        )

    pairs = pair_within(left, right, [], []).select("rows", "other")
    return tile_map(pairs, kernel, "cell_id bigint, proto_id int, s double")


def _best_dot_tiled(cells: DataFrame, protos: DataFrame) -> DataFrame:
    """Largest dot product against any number of prototypes: one candidate per tile pair row."""
    left = pack(cells.select("cell_id", "vec"), [])
    right = pack(protos.select(F.col("proto_id").cast("bigint").alias("cell_id"), "vec"), [])

    def kernel(row: dict) -> pa.RecordBatch:
        a, x = unpack(row["rows"])
        b, p = unpack(row["other"])
        order = np.argsort(b)
        s = x @ p[order].T
        j = s.argmax(1)
        return pa.record_batch(
            [pa.array(a), pa.array(b[order][j].astype(np.int32)), pa.array(s[np.arange(len(a)), j])],
            names=["cell_id", "proto_id", "score"],
        )

    pairs = pair_within(left, right, [], []).select("rows", "other")
    found = tile_map(pairs, kernel, "cell_id bigint, proto_id int, score double")
    best = found.groupBy("cell_id").agg(F.max(F.struct("score", F.negative("proto_id").alias("n"))).alias("_m"))
    return cells.join(
        best.select("cell_id", F.negative("_m.n").alias("proto_id"), F.col("_m.score").alias("score")), "cell_id"
    )


def nearest_prototype(cells: DataFrame, protos: DataFrame, metric: str = "l2") -> DataFrame:
    """Add ``proto_id`` and ``score`` of the best prototype (``l2``: smallest, ``dot``: largest).

    Ties (to rounding) go to the lowest id.  Nothing wider than one value per
    cell leaves the task, and no shuffle is needed.
    """
    bounded = bounded_matrix(protos, "proto_id", "vec", max_rows=65536)
    if bounded is None:
        if metric == "dot":
            return _best_dot_tiled(cells, protos)
        base = protos.select(F.col("proto_id").cast("bigint").alias("cell_id"), "vec")
        best = knn_join(cells.select("cell_id", "vec"), base, 1, metric)
        return cells.join(
            best.select(F.col("src").alias("cell_id"), F.col("dst").cast("int").alias("proto_id"), F.col("dist").alias("score")),
            "cell_id",
        )
    ids, p = bounded
    ids = ids.astype(np.int32)
    if metric == "cosine":
        p = V.unit_rows(p)

    def best(col: pa.Array) -> pa.Array:
        x = V.matrix(col)
        pick = np.zeros(len(x), dtype=np.int64)
        val = np.zeros(len(x))
        step = max(1, BLOCK // len(p))
        for i in range(0, len(x), step):
            b = x[i : i + step]
            if metric == "cosine":
                s = 1.0 - V.unit_rows(b) @ p.T
            else:
                s = _block_scores(b, p, metric)
            key = -s if metric == "dot" else s
            low = key.min(1, keepdims=True)
            j = (key <= low + 1e-12 * (1.0 + np.abs(low))).argmax(1)
            pick[i : i + step] = j
            val[i : i + step] = s[np.arange(len(b)), j]
        return pa.StructArray.from_arrays([pa.array(ids[pick]), pa.array(val)], ["proto_id", "score"])

    kind = T.StructType([T.StructField("proto_id", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return cells.withColumn("_b", F.arrow_udf(best, kind)("vec")).select(
        *cells.columns, F.col("_b.proto_id").alias("proto_id"), F.col("_b.score").alias("score")
    )


def nearest_prototype_vector(cells: DataFrame, protos: DataFrame) -> DataFrame:
    """Most similar prototype of each cell together with its vector."""
    best = nearest_prototype(cells, protos, "dot")
    return best.select("cell_id", "proto_id", "score").join(protos.select("proto_id", F.col("vec").alias("proto_vec")), "proto_id")


def nearest_cell(cells: DataFrame, protos: DataFrame) -> DataFrame:
    """Nearest real cell of each prototype with its annotations."""
    best = top_cells(cells, protos, 1, "l2")
    return best.select("proto_id", "cell_id", F.col("s").alias("dist")).join(cells.drop("vec"), "cell_id")


# --- purity and labels ----------------------------------------------------------------------


def _label_counts(assigned: DataFrame, label: str) -> DataFrame:
    return assigned.groupBy("proto_id", label).agg(F.count("*").alias("_n"))


def prototype_purity(assigned: DataFrame, protos: DataFrame, label: str = "cell_type") -> DataFrame:
    """Count and purity per prototype; an empty prototype has count 0 and NULL purity."""
    per = _label_counts(assigned, label).groupBy("proto_id").agg(
        F.sum("_n").alias("n"), (F.max("_n") / F.sum("_n")).alias("purity")
    )
    return protos.select("proto_id").join(per, "proto_id", "left").select(
        "proto_id", F.coalesce("n", F.lit(0)).alias("n"), "purity"
    )


def purity_summary(purity: DataFrame) -> DataFrame:
    """Purity over non-empty prototypes, counts over all."""
    return purity.agg(
        F.min("purity").alias("min_purity"),
        F.max("purity").alias("max_purity"),
        F.avg("purity").alias("avg_purity"),
        (F.sum(F.col("purity") * F.col("n")) / F.sum("n")).alias("weighted_purity"),
        F.min("n").alias("min_count"),
        F.max("n").alias("max_count"),
        F.avg("n").alias("avg_count"),
    )


def label_by_top_cells(scores: DataFrame, cells: DataFrame, k: int = 10, label: str = "cell_type") -> DataFrame:
    """Majority label of each prototype's k most similar cells; ``scores`` may be the rows of :func:`top_cells`.

    Confidence divides by ``k`` even when fewer rows exist; the lowest label wins a tie.
    """
    top = top_k(scores, ["proto_id"], [F.desc("s"), F.asc("cell_id")], k)
    counts = _label_counts(top.join(cells.select("cell_id", label), "cell_id"), label)
    return counts.groupBy("proto_id").agg(
        F.min_by(label, F.struct(F.negative("_n"), F.col(label))).alias("proto_label"),
        (F.max("_n") / F.lit(k)).alias("confidence"),
    )


def label_by_assigned(assigned: DataFrame, protos: DataFrame, label: str = "cell_type") -> DataFrame:
    """Majority label of the cells assigned to each prototype; empty: ``none``, 0, 0."""
    per = _label_counts(assigned, label).groupBy("proto_id").agg(
        F.min_by(label, F.struct(F.negative("_n"), F.col(label))).alias("_l"),
        (F.max("_n") / F.sum("_n")).alias("_c"),
        F.sum("_n").alias("_t"),
    )
    return protos.select("proto_id").join(per, "proto_id", "left").select(
        "proto_id",
        F.coalesce("_l", F.lit("none")).alias("proto_label"),
        F.coalesce("_c", F.lit(0.0)).alias("certainty"),
        F.coalesce("_t", F.lit(0)).alias("n"),
    )


def labelled_prototypes(protos: DataFrame, labels: DataFrame) -> DataFrame:
    """Prototype vectors with label and confidence; one never reached is ``Unknown``, 0."""
    return protos.join(labels, "proto_id", "left").select(
        "proto_id",
        "vec",
        F.coalesce("proto_label", F.lit("Unknown")).alias("proto_label"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


# --- geometry -------------------------------------------------------------------------------


def _as_cells(protos: DataFrame) -> DataFrame:
    return protos.select(F.col("proto_id").cast("bigint").alias("cell_id"), F.col("vec").cast("array<double>").alias("vec"))


def prototype_pairs(protos: DataFrame) -> DataFrame:
    """Distances of every ordered prototype pair i <> j."""
    rows = pair_scores(_as_cells(protos), protos, "l2")
    return rows.where("cell_id <> proto_id").select(
        F.col("cell_id").cast("int").alias("i"), F.col("proto_id").alias("j"), F.col("s").alias("d")
    )


def nearest_prototype_distance(protos: DataFrame) -> DataFrame:
    """Minimum, mean and maximum over prototypes of the distance to the nearest other one."""
    near = knn_graph(_as_cells(protos), 1, "l2")
    return near.agg(F.min("dist").alias("min_d"), F.avg("dist").alias("avg_d"), F.max("dist").alias("max_d"))


def _pair_sums(protos: DataFrame) -> DataFrame:
    """Per prototype: sum of d, and of 1 / (d + 1e-5) over j > i.  Tile kernel, any size."""
    tiles = pack(_as_cells(protos), [])

    def kernel(row: dict) -> pa.RecordBatch:
        a, x = unpack(row["rows"])
        b, p = unpack(row["other"])
        d = _block_scores(x, p, "l2")
        d[a[:, None] == b[None, :]] = 0.0
        inv = np.where(a[:, None] < b[None, :], 1.0 / (d + 1e-5), 0.0)
        return pa.record_batch([pa.array(a), pa.array(d.sum(1)), pa.array(inv.sum(1))], names=["i", "sd", "sinv"])

    pairs = pair_within(tiles, tiles, [], []).select("rows", "other")
    return tile_map(pairs, kernel, "i bigint, sd double, sinv double").groupBy("i").agg(
        F.sum("sd").alias("sd"), F.sum("sinv").alias("sinv")
    )


def mean_pairwise_distance(protos: DataFrame) -> DataFrame:
    """Average over prototypes of the mean distance to the others."""
    return _pair_sums(protos).agg((F.sum("sd") / (F.count("*") * (F.count("*") - 1))).alias("mean_d"))


def repulsion(protos: DataFrame) -> DataFrame:
    """Sum over i < j of 1 / (d + 1e-5)."""
    return _pair_sums(protos).agg(F.sum("sinv").alias("repulsion"))


def coverage(cells: DataFrame, protos: DataFrame) -> DataFrame:
    """Largest cosine distance from a cell to its nearest prototype."""
    unit_p = protos.select("proto_id", V.unit("vec").alias("vec"))
    return nearest_prototype(cells, unit_p, "cosine").agg(F.max("score").alias("coverage"))


def coverage_by(cells: DataFrame, protos: DataFrame, by: str) -> DataFrame:
    return nearest_prototype(cells, protos, "cosine").groupBy(by).agg(F.max("score").alias("coverage"))


def _column_minima(cells: DataFrame, protos: DataFrame, metric: str) -> DataFrame:
    """Per prototype, the smallest distance to any cell: one K-row partial per Arrow batch."""
    bounded = bounded_matrix(protos, "proto_id", "vec")
    if bounded is None:
        return _scores_tiled(cells.select("cell_id", "vec"), protos, metric).groupBy("proto_id").agg(F.min("s").alias("d"))
    ids, p = bounded
    ids = ids.astype(np.int32)

    def run(batches):
        low = np.full(len(p), np.inf)
        for b in batches:
            x = V.matrix(b.column(0))
            step = max(1, BLOCK // len(p))
            for i in range(0, len(x), step):
                low = np.minimum(low, _block_scores(x[i : i + step], p, metric).min(0))
        if np.isfinite(low).all():
            yield pa.record_batch([pa.array(ids), pa.array(low)], names=["proto_id", "d"])

    return cells.select("vec").mapInArrow(run, "proto_id int, d double").groupBy("proto_id").agg(F.min("d").alias("d"))


def prototype_coverage(cells: DataFrame, protos: DataFrame) -> DataFrame:
    """Largest over prototypes of the smallest cosine distance to a cell."""
    uc = cells.select("cell_id", V.unit_kernel()("vec").alias("vec"))
    up = protos.select("proto_id", V.unit("vec").alias("vec"))
    # on unit vectors 1 - dot = d^2 / 2
    return _column_minima(uc, up, "l2").agg(F.max(F.col("d") * F.col("d") / 2).alias("prototype_coverage"))


def prototype_cost(cells: DataFrame, protos: DataFrame, weight: float = 0.05) -> DataFrame:
    """weight * mean over cells of the nearest-prototype distance + the same the other way."""
    by_cell = nearest_prototype(cells, protos, "l2").agg(F.avg("score").alias("c")).scalar()
    return _column_minima(cells, protos, "l2").agg(F.avg("d").alias("p")).select(
        (F.lit(weight) * by_cell + F.lit(weight) * F.col("p")).alias("cost")
    )


def distance_embedding(cells: DataFrame, protos: DataFrame, key: str = "X_proto") -> DataFrame:
    """Distances to every prototype as a new embedding."""
    scored = score_arrays(cells, protos, "l2", out="_d")
    return scored.select("cell_id", F.lit(key).alias("key"), F.col("_d").alias("vec"))

"""Balanced assignment of cells to prototypes and the scores built on it.

A cell's scores are one array ``s`` in prototype order, so every per-cell step is
row-local; only K prototype sums per round cross the network.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as V
from ..functions.rand import uniform
from ..session import cut_lineage
from .proto import nearest_prototype
from .tiles import pack, pair_within, tile_map, unpack


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def _argmax(a: Column) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(a, F.array_max(a))


def soft_weights(scores: DataFrame, epsilon: float = 0.05, out: str = "q") -> DataFrame:
    """exp(s / epsilon) without balancing."""
    return scores.withColumn(out, F.transform("s", lambda x: F.exp(x / epsilon)))


def _lse(m: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of every row; -inf for a row of -inf."""
    top = m.max(1, initial=-np.inf)
    with np.errstate(divide="ignore"):
        return np.where(np.isfinite(top), top, 0.0) + np.log(np.exp(m - np.where(np.isfinite(top), top, 0.0)[:, None]).sum(1))


def _cell_factor(l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Log factor that brings every cell's row to unit mass; 0 for a cell that no prototype can take."""
    c = -_lse(l + r)
    return np.where(np.isfinite(c), c, 0.0)


def _column_partials(n_by: int):
    """Per batch and group the maximum over cells of ``l + c`` for each prototype, and the sum of exponentials below it."""

    def run(batches):
        for batch in batches:
            l, r = V.matrix(batch.column("_l")), V.matrix(batch.column("_r"))
            if not len(l):
                continue
            v = l + _cell_factor(l, r)[:, None] if r.shape[1] else l
            code = np.zeros(len(l), dtype=np.int64)
            for i in range(n_by):
                own = batch.column(i).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            top = np.maximum.reduceat(v[order], first, axis=0)
            safe = np.where(np.isfinite(top), top, 0.0)
            sums = np.add.reduceat(np.exp(v[order] - np.repeat(safe, np.diff(np.append(first, len(v))), axis=0)), first, axis=0)
            keys = batch.take(pa.array(order[first]))
            names = batch.schema.names[:n_by]
            yield pa.RecordBatch.from_arrays([*[keys.column(i) for i in range(n_by)], V.row_lists(safe), V.row_lists(sums)], names=[*names, "m", "s"])

    return run


def sinkhorn(
    scores: DataFrame, epsilon: float = 0.05, iterations: int = 3, by: Sequence[str] = (), out: str = "q"
) -> DataFrame:
    """Balanced assignment inside each ``by`` group (all rows when empty), in logarithms.

    Each round scales prototypes to equal mass, then cells to unit mass.  With l = s / epsilon the matrix stays
    exp(l + r_k + c_cell): a round gives every cell its c from the current r and reduces each batch to one
    maximum and one sum of exponentials per group and prototype; batches meet in a log-sum-exp under the common
    maximum.  So no range of scores makes a prototype's column vanish or overflow.  The last step
    scales cells: every cell's row sums to 1.  Scores are computed once; between rounds only K numbers per group are
    written.  A prototype that no cell can take (all scores -inf) gets nothing, a null key is a group like any other.
    """
    by = list(by)
    base = cut_lineage(scores.withColumn("_l", F.transform("s", lambda x: x / epsilon)))
    keys = [F.col(f"`{c}`") for c in by]
    kinds = "".join(f"`{c}` {base.schema[c].dataType.simpleString()}, " for c in by)
    named = [f"_by{i}" for i in range(len(by))]

    def with_factors(rows: DataFrame | None) -> DataFrame:
        if rows is None:
            return base.withColumn("_r", F.array().cast("array<double>"))
        if not by:
            return base.withColumn("_r", rows.select("_r").scalar())
        on = F.lit(True)
        for c, n in zip(keys, named):
            on = on & c.eqNullSafe(F.col(n))
        return base.join(rows, on).drop(*named)

    rows = None
    for _ in range(iterations):
        partial = with_factors(rows).select(*keys, "_l", "_r").mapInArrow(_column_partials(len(by)), f"{kinds}m array<double>, s array<double>")
        each = partial.select(*[c.alias(n) for c, n in zip(keys, named)], F.posexplode(F.arrays_zip("m", "s")).alias("_k", "_e"))
        each = each.select(*named, "_k", F.col("_e.m").alias("m"), F.when(F.col("_e.s") > 0, F.col("_e.s")).alias("s"))
        # batches without a finite score of a prototype have no say in its maximum
        top = F.max(F.when(F.col("s").isNotNull(), F.col("m"))).over(Window.partitionBy(*named, "_k"))
        summed = each.withColumn("_top", top).groupBy(*named, "_k").agg(F.first("_top").alias("_top"), F.sum(F.col("s") * F.exp(F.col("m") - F.col("_top"))).alias("_s"))
        factor = F.coalesce(-(F.col("_top") + F.log("_s")), F.lit(float("-inf")))
        listed = summed.groupBy(*named).agg(F.array_sort(F.collect_list(F.struct("_k", factor.alias("r")))).alias("_f"))
        rows = cut_lineage(listed.select(*named, F.transform("_f", lambda e: e["r"] - F.log(F.size("_f").cast("double"))).alias("_r")))

    def weights(l: pa.Array, r: pa.Array) -> pa.Array:
        l, r = V.matrix(l), V.matrix(r)
        if not len(l):
            return pa.array([], type=pa.list_(pa.float64()))
        r = r if r.shape[1] else np.zeros((1, l.shape[1]))
        c = _cell_factor(l, r) if iterations else np.zeros(len(l))
        return V.row_lists(np.exp(l + r + c[:, None]))

    q = F.arrow_udf(weights, T.ArrayType(T.DoubleType()))
    return with_factors(rows).withColumn(out, q("_l", "_r")).select(*[c for c in scores.columns if c != out], out)


def hard_assignment(scores: DataFrame, source: str = "s", out: str = "q") -> DataFrame:
    """1.0 at the first maximum, 0.0 elsewhere."""
    best = _argmax(F.col(source))
    return scores.withColumn("_best", best).withColumn(
        out, F.transform(source, lambda x, i: F.when(i + 1 == F.col("_best"), 1.0).otherwise(0.0))
    ).drop("_best")


def softmax(scores: DataFrame, temperature: float = 0.1, out: str = "p") -> DataFrame:
    top = F.array_max("s")
    e = F.transform("s", lambda x: F.exp((x - F.col("_m")) / temperature))
    return (
        scores.withColumn("_m", top).withColumn("_x", e).withColumn("_t", _total(F.col("_x")))
        .withColumn(out, F.transform("_x", lambda v: v / F.col("_t"))).drop("_m", "_x", "_t")
    )


def log_softmax(scores: DataFrame, temperature: float = 0.1, out: str = "logp") -> DataFrame:
    e = F.transform("s", lambda x: F.exp((x - F.col("_m")) / temperature))
    return (
        scores.withColumn("_m", F.array_max("s")).withColumn("_z", F.log(_total(e)))
        .withColumn(out, F.transform("s", lambda x: (x - F.col("_m")) / temperature - F.col("_z"))).drop("_m", "_z")
    )


def queue_assignment(queue: DataFrame, batch: DataFrame, size: int, **kw) -> DataFrame:
    """Sinkhorn over the last ``size`` queued rows plus the batch; batch rows are returned.

    ``queue(cell_id, step, s)``: the newest rows win; the bound is the feature.
    """
    recent = queue.orderBy(F.desc("step"), F.desc("cell_id")).limit(size)
    both = recent.select("cell_id", "s", F.lit(False).alias("_now")).unionAll(
        batch.select("cell_id", "s", F.lit(True).alias("_now"))
    )
    return sinkhorn(both, **kw).where("_now").select("cell_id", "q")


# --- scores over view pairs ------------------------------------------------------------------


def _cross_views(q: DataFrame, p: DataFrame, q_col: str, p_col: str) -> DataFrame:
    """(q of view i) with (p of view v), v <> i; pairs per anchor are views x (views - 1)."""
    left = q.select("anchor_id", F.col("view_no").alias("_i"), F.col(q_col).alias("_q"))
    right = p.select("anchor_id", F.col("view_no").alias("_v"), F.col(p_col).alias("_p"))
    return left.join(right, "anchor_id").where("_i <> _v")


def _mean_over_crops(pairs: DataFrame, value: Column, out: str) -> DataFrame:
    per = pairs.groupBy("_i", "_v").agg(F.avg(value).alias("_m"))
    return per.groupBy("_i").agg(F.avg("_m").alias("_m")).agg(F.avg("_m").alias(out))


def swapped_cross_entropy(q: DataFrame, scores: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Mean of -sum(q_i * log p_v) over the other views, then over assigned views."""
    pairs = _cross_views(q, log_softmax(scores, temperature), "q", "logp")
    return _mean_over_crops(pairs, -_total(F.zip_with("_q", "_p", lambda a, b: a * b)), "loss")


def swapped_kl(q: DataFrame, scores: DataFrame, temperature: float = 0.1, reverse: bool = False) -> DataFrame:
    """KL(q || p), or KL(p || q) with ``reverse``, over swapped views.

    True divergences: probabilities are logged once.
    """
    tiny = 1e-9
    pairs = _cross_views(q, softmax(scores, temperature), "q", "p")
    if reverse:
        term = F.zip_with("_p", "_q", lambda a, b: a * (F.log(a + tiny) - F.log(b + tiny)))
    else:
        term = F.zip_with("_q", "_p", lambda a, b: a * (F.log(a + tiny) - F.log(b + tiny)))
    return _mean_over_crops(pairs, _total(term), "kl")


def pair_matching(a: DataFrame, b: DataFrame, key: str = "anchor_id") -> DataFrame:
    """How many anchors have the same best prototype in both views."""
    left = a.select(key, _argmax(F.col("s")).alias("_a"))
    right = b.select(key, _argmax(F.col("s")).alias("_b"))
    same = F.sum((F.col("_a") == F.col("_b")).cast("bigint"))
    return left.join(right, key).agg(same.alias("matches"), (same / F.count("*")).alias("ratio"))


def usage_entropy(probabilities: DataFrame) -> DataFrame:
    """Entropy of prototype usage (natural log) and the mean entropy of a row."""
    usage = vector_to_array(Summarizer.sum(array_to_vector(F.col("p"))))
    row = -_total(F.transform("p", lambda x: x * F.log(x + 1e-9)))
    agg = probabilities.agg(usage.alias("_u"), F.avg(row).alias("row_entropy"))
    shared = agg.withColumn("_t", _total(F.col("_u"))).withColumn("_u", F.transform("_u", lambda x: x / F.col("_t")))
    ent = -_total(F.transform(F.filter("_u", lambda x: x > 0), lambda x: x * F.log(x)))
    return shared.select(ent.alias("usage_entropy"), "row_entropy")


def contrastive_score(views: DataFrame, temperature: float = 0.5) -> DataFrame:
    """NT-Xent of two views per anchor inside each ``batch_no``.

    ``views(batch_no, anchor_id, view_no in {0, 1}, vec)``.  The sums over the batch
    come from tile kernels: one partial sum per row and tile, no pair rows.
    """
    unit = views.select(
        "batch_no", "anchor_id", "view_no", (F.col("anchor_id") * 2 + F.col("view_no")).alias("cell_id"),
        V.unit_kernel()("vec").alias("vec"),
    )
    tiles = pack(unit.select("batch_no", "cell_id", "vec"), ["batch_no"])

    def kernel(row: dict) -> pa.RecordBatch:
        a, x = unpack(row["rows"])
        b, y = unpack(row["other"])
        s = np.exp((x @ y.T - 1.0) / temperature)
        s[a[:, None] == b[None, :]] = 0.0
        return pa.record_batch([pa.array(a), pa.array(s.sum(1))], names=["cell_id", "e"])

    pairs = pair_within(tiles, tiles, ["batch_no"], ["batch_no"]).select("rows", "other")
    sums = tile_map(pairs, kernel, "cell_id bigint, e double").groupBy("cell_id").agg(F.sum("e").alias("_e"))
    both = unit.groupBy("batch_no", "anchor_id").agg(
        F.max(F.when(F.col("view_no") == 0, F.col("vec"))).alias("_a"), F.max(F.when(F.col("view_no") == 1, F.col("vec"))).alias("_b")
    )
    positive = both.select("batch_no", "anchor_id", V.dot(F.col("_a"), F.col("_b")).alias("_pos"))
    per_row = sums.withColumn("anchor_id", F.floor(F.col("cell_id") / 2)).join(positive, "anchor_id")
    loss = F.log("_e") + F.lit(1.0 / temperature) - F.col("_pos") / temperature
    return per_row.groupBy("batch_no").agg(F.avg(loss).alias("loss"))


def redundancy_score(pairs: DataFrame, lam: float = 0.0051, eps: float = 1e-5) -> DataFrame:
    """Cross-correlation score of two views ``(a, b)``: sum (1 - c_ii)^2 + lam * sum c_ij^2.

    Each Arrow stream yields one partial of the moment sums; the total is d x d.
    """

    def partial(batches):
        acc = None
        for batch in batches:
            a, b = V.matrix(batch.column(0)), V.matrix(batch.column(1))
            if not len(a):
                continue
            part = np.concatenate([(a.T @ b).reshape(-1), a.sum(0), b.sum(0), (a * a).sum(0), (b * b).sum(0), [len(a)]])
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.record_batch([V.row_lists(acc[None, :])], names=["m"])

    def finish(col: pa.Array) -> pa.Array:
        out = []
        for m in V.matrix(col):
            d = int(round(np.sqrt(len(m) - 1 + 4))) - 2
            cross, rest, n = m[: d * d].reshape(d, d), m[d * d : -1].reshape(4, d), m[-1]
            ma, mb = rest[0] / n, rest[1] / n
            va, vb = rest[2] / n - ma**2, rest[3] / n - mb**2
            c = (cross / n - np.outer(ma, mb)) / np.sqrt(np.outer(va + eps, vb + eps))
            diag = np.diag(c)
            out.append(float(((1 - diag) ** 2).sum() + lam * ((c**2).sum() - (diag**2).sum())))
        return pa.array(out, type=pa.float64())

    sums = pairs.select("a", "b").mapInArrow(partial, "m array<double>")
    total = sums.agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("m")))).alias("m"))
    return total.select(F.arrow_udf(finish, "double")("m").alias("redundancy"))


# --- clustering ------------------------------------------------------------------------------


def kmeans_prototypes(cells: DataFrame, k: int, seed: int = 0, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """(prototypes, assigned cells) from k-means on the vectors."""
    from pyspark.ml.clustering import KMeans

    features = cells.withColumn("_f", array_to_vector(F.col("vec")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="proto_id").fit(features)
    centres = cells.sparkSession.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "proto_id int, vec array<double>"
    )
    return centres, model.transform(features).drop("_f")


def spherical_kmeans(cells: DataFrame, k: int, rounds: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """k-means on unit vectors by dot product: (centroids, cells with ``proto_id``).

    Starts from the ``k`` cells with the smallest keyed draw, numbered by id.  A centroid
    without cells keeps its place.  Unit vectors are written once; a round is one scan
    with map-side sums, and centroids stay a table (of any size).
    """
    unit = cut_lineage(cells.withColumn("vec", V.unit_kernel()("vec")))
    start = unit.select("cell_id", "vec").orderBy(uniform(seed, "centroid", F.col("cell_id")), "cell_id").limit(k)
    number = (F.row_number().over(Window.orderBy("cell_id")) - 1).cast("int")  # k rows
    centre = cut_lineage(start.select(number.alias("proto_id"), "vec"))
    for _ in range(rounds):
        moved = nearest_prototype(unit, centre, "dot").groupBy("proto_id").agg(V.mean_vector("vec").alias("_new"))
        centre = cut_lineage(centre.join(moved, "proto_id", "left").select("proto_id", F.coalesce(V.unit("_new"), "vec").alias("vec")))
    return centre, nearest_prototype(unit, centre, "dot")


def spherical_kmeans_banks(banks: dict[int, DataFrame], ks: Sequence[int], rounds: int = 10, seed: int = 0) -> DataFrame:
    """One assignment per requested k, banks used in turn: ``(run, k, cell_id, proto_id)``."""
    order = sorted(banks)
    out = None
    for run, k in enumerate(ks):
        cells = banks[order[run % len(order)]]
        _, assigned = spherical_kmeans(cells, k, rounds, seed + run)
        part = assigned.select(F.lit(run).alias("run"), F.lit(k).alias("k"), "cell_id", "proto_id")
        out = part if out is None else out.unionAll(part)
    return out


# --- memory bank -------------------------------------------------------------------------------


def bank_latest(bank: DataFrame) -> DataFrame:
    """Latest vector per (bank, cell): partial ``max_by`` before the shuffle."""
    return bank.groupBy("bank_no", "cell_id").agg(
        F.max_by("vec", "step").alias("vec"), F.max("step").alias("step")
    )


def bank_update(bank: DataFrame, arriving: DataFrame) -> DataFrame:
    """Bank after an update: arriving rows replace older ones of the same key."""
    return bank_latest(bank.unionByName(arriving))

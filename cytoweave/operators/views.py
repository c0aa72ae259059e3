"""Related-cell samples ("views") for every anchor in one set-based job.

Output of the samplers: ``views(anchor_id, view_no, cell_id, complete)``; view 0 is
the anchor.  Candidates are numbered inside their pool, each anchor draws distinct
numbers, and an equi-join on (pool, number) fetches the cells.  The work grows with
anchors x views, never with pool sizes squared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.rand import uniform
from ..functions.ranks import uniform_rank
from ..session import cut_lineage


def _numbered(cells: DataFrame, pool: str, part: str | None, seed: int) -> DataFrame:
    """Cells numbered 0.. inside ``pool``, each ``part`` being one contiguous run.

    Adds ``_n`` (pool size), ``_start`` and ``_len`` (the run of the cell's part).
    Anchors and candidates both read it, so it is written once.
    """
    keys = [pool] + ([part] if part else [])
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("_len"))
    # one row per (pool, part): label-sized
    order = Window.partitionBy(pool).orderBy(*(keys[1:] or [F.lit(0)]))
    sizes = sizes.withColumn("_start", F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_len"))
    sizes = sizes.withColumn("_n", F.sum("_len").over(Window.partitionBy(pool)))
    drawn = cells.select("cell_id", *keys).withColumn("_u", uniform(seed, "pool", F.col("cell_id")))
    ranked = uniform_rank(drawn, "_u", "cell_id", keys, "_rn")
    return cut_lineage(ranked.join(sizes, keys).withColumn("_idx", F.col("_start") + F.col("_rn") - 1).drop("_u", "_rn"))


def _with_draws(anchors: DataFrame, n_draws: int, seed: int, op: str) -> DataFrame:
    """Add ``_draws``: ``_wanted`` different numbers below ``_size``, uniform over subsets.

    Draw i is uniform over the first size - wanted + i + 1 numbers; a repeat is
    replaced by the newest number of that range.  Draws are plain columns (compiled
    code); unused ones are NULL.
    """
    df = anchors
    for i in range(n_draws):
        last = F.col("_size") - F.col("_wanted") + i
        df = df.withColumn("_t", F.floor(uniform(seed, op, F.col("anchor_id"), i) * (last + 1)).cast("bigint"))
        seen = F.lit(False)
        for j in range(i):
            seen = seen | (F.col("_t") == F.col(f"_p{j}"))
        df = df.withColumn(f"_p{i}", F.when(F.lit(i) < F.col("_wanted"), F.when(seen, last).otherwise(F.col("_t"))))
    picks = [F.struct(F.lit(i + 1).alias("view_no"), F.col(f"_p{i}").alias("p")) for i in range(n_draws)]
    return df.withColumn("_draws", F.array(*picks)).drop("_t", *[f"_p{i}" for i in range(n_draws)])


def _fetch(anchors: DataFrame, numbered: DataFrame, pool: str, n_views: int, seed: int, op: str) -> DataFrame:
    """Draw from the ring segment (``_base``, ``_size``) of each anchor's pool."""
    wanted = F.least(F.lit(n_views - 1).cast("bigint"), F.col("_size"))
    sized = anchors.withColumn("_wanted", wanted).withColumn("complete", F.col("_wanted") == n_views - 1)
    first = sized.select("anchor_id", F.lit(0).alias("view_no"), F.col("anchor_id").alias("cell_id"), "complete")
    if n_views < 2:
        return first
    drawn = _with_draws(sized, n_views - 1, seed, op).select(
        "anchor_id", pool, "complete", "_base", "_n", F.explode("_draws").alias("_d")
    )
    picks = drawn.where(F.col("_d.p").isNotNull()).select(
        "anchor_id", pool, "complete", F.col("_d.view_no").alias("view_no"), F.pmod(F.col("_base") + F.col("_d.p"), F.col("_n")).alias("_idx")
    )
    found = picks.join(numbered.select(pool, "_idx", "cell_id"), [pool, "_idx"]).select("anchor_id", "view_no", "cell_id", "complete")
    return first.unionAll(found)


def same_type_views(cells: DataFrame, n_views: int, anchors: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Same label, preferring other studies.

    The pool is the other-study part when it has more than ``n_views`` cells, else
    the whole label (which may return the anchor itself).
    """
    numbered = _numbered(cells, "cell_type", "study", seed)
    other = F.col("_n") - F.col("_len")
    use_other = other > n_views
    chosen = numbered if anchors is None else numbered.join(anchors.select("cell_id"), "cell_id", "left_semi")
    ring = chosen.select(
        F.col("cell_id").alias("anchor_id"),
        "cell_type",
        "_n",
        F.when(use_other, F.col("_start") + F.col("_len")).otherwise(0).cast("bigint").alias("_base"),
        F.when(use_other, other).otherwise(F.col("_n")).cast("bigint").alias("_size"),
    )
    return _fetch(ring, numbered, "cell_type", n_views, seed, "type")


def same_group_views(cells: DataFrame, group: str, n_views: int, seed: int = 0) -> DataFrame:
    """Members of the anchor's group (community), possibly the anchor itself."""
    numbered = _numbered(cells, group, None, seed)
    ring = numbered.select(
        F.col("cell_id").alias("anchor_id"), group, "_n", F.lit(0).cast("bigint").alias("_base"), F.col("_n").cast("bigint").alias("_size")
    )
    return _fetch(ring, numbered, group, n_views, seed, "group")


def one_partner(cells: DataFrame, label: str = "cell_type", seed: int = 0) -> DataFrame:
    """One uniformly drawn same-label partner per cell (may be the cell itself)."""
    numbered = _numbered(cells, label, None, seed)
    pick = F.floor(uniform(seed, "partner", F.col("cell_id")) * F.col("_n")).cast("bigint")
    asked = numbered.select(F.col("cell_id").alias("anchor_id"), label, pick.alias("_idx"))
    return asked.join(numbered.select(label, "_idx", F.col("cell_id").alias("partner_id")), [label, "_idx"]).select(
        "anchor_id", "partner_id"
    )


def random_walk_views(
    knn: DataFrame,
    anchors: DataFrame,
    n_views: int,
    longest: int = 3,
    weight: str = "distance",
    seed: int = 0,
) -> DataFrame:
    """Ends of random walks on the kNN graph, one walk per view.

    Length is uniform in 1..``longest``; a step goes to a neighbour with probability
    proportional to its ``distance`` (so farther ones are likelier), its ``inverse``
    or ``uniform``.  All-zero weights fall back to uniform.
    """
    w = {"distance": F.col("dist"), "inverse": 1.0 / (F.col("dist") + 1e-12), "uniform": F.lit(1.0)}[weight]
    hops = knn.select("src", "rank", "dst", w.alias("w")).groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("rank", "dst", "w"))).alias("_hops")
    )
    total = F.aggregate("_hops", F.lit(0.0), lambda t, h: t + h["w"])
    hops = hops.withColumn("_flat", total == 0)
    hops = hops.withColumn("_hops", F.transform("_hops", lambda h: F.struct(h["dst"].alias("dst"), F.when(F.col("_flat"), 1.0).otherwise(h["w"]).alias("w"))))
    hops = hops.withColumn("_total", F.aggregate("_hops", F.lit(0.0), lambda t, h: t + h["w"])).drop("_flat")
    views = F.explode(F.sequence(F.lit(1), F.lit(n_views - 1)))
    walk = anchors.select(F.col("cell_id").alias("anchor_id"), views.alias("view_no"))
    length = F.floor(uniform(seed, "len", F.col("anchor_id"), F.col("view_no")) * longest) + 1
    walk = walk.withColumn("_left", length).withColumn("cell_id", F.col("anchor_id"))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("bigint").alias("dst"))
    for step in range(longest):
        aim = uniform(seed, "step", F.col("anchor_id"), F.col("view_no"), step) * F.col("_total")
        walk = walk.join(hops.withColumnRenamed("src", "_at"), F.col("cell_id") == F.col("_at"), "left").withColumn("_aim", aim)
        picked = F.aggregate(
            "_hops",
            start,
            lambda s, h: F.struct(
                (s["run"] + h["w"]).alias("run"),
                F.when(s["dst"].isNull() & (s["run"] + h["w"] > F.col("_aim")), h["dst"]).otherwise(s["dst"]).alias("dst"),
            ),
        )["dst"]
        # rounding may leave the aim at the very end: the last neighbour then
        landed = F.coalesce(picked, F.element_at("_hops", -1)["dst"], F.col("cell_id"))
        walk = walk.select(
            "anchor_id", "view_no", "_left", F.when(F.col("_left") > step, landed).otherwise(F.col("cell_id")).alias("cell_id")
        )
    first = anchors.select(F.col("cell_id").alias("anchor_id"), F.lit(0).alias("view_no"), "cell_id", F.lit(True).alias("complete"))
    return first.unionAll(walk.select("anchor_id", "view_no", "cell_id", F.lit(True).alias("complete")))


def mixed_views(
    cells: DataFrame, knn: DataFrame, n_views: int, ratio: float = 0.5, longest: int = 3, seed: int = 0
) -> DataFrame:
    """Per anchor: same-type views with probability ``ratio``, else random walks."""
    u = uniform(seed, "mix", F.col("cell_id"))
    typed = same_type_views(cells, n_views, cells.where(u < ratio), seed)
    walked = random_walk_views(knn, cells.where(u >= ratio).select("cell_id"), n_views, longest, seed=seed)
    return typed.unionAll(walked)


def _binomial_steps(r: float, p: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... failures, up to where the rest is below 1e-12."""
    n = 64
    while True:
        k = np.arange(1, n)
        logs = np.concatenate([[r * np.log(p)], r * np.log(p) + np.cumsum(np.log(k - 1 + r) - np.log(k) + np.log1p(-p))])
        steps = np.cumsum(np.exp(logs))
        if steps[-1] > 1.0 - 1e-12 or n >= 1 << 22:
            return steps
        n *= 2


def noise_views(
    dense: DataFrame, mean: Sequence[float], dispersion: Sequence[float], n_views: int, form: str = "reference", seed: int = 0
) -> DataFrame:
    """Add negative-binomial noise to dense profiles ``(cell_id, vec)``, floored at zero.

    ``form='reference'`` uses success probability mu / (mu + r) (noise mean r^2 / mu);
    ``'standard'`` uses r / (mu + r) (noise mean mu).  Genes with mean 0 get no noise.
    Every (cell, view, gene) has a keyed uniform draw, which the inverse distribution turns
    into a count: retries and partitions repeat it.
    """
    mu = np.asarray(mean, dtype=np.float64)
    r = np.asarray(dispersion, dtype=np.float64)
    live = mu > 0
    p = np.where(live, (mu if form == "reference" else r) / np.where(live, mu + r, 1.0), 0.5)

    def run(batches):
        steps: dict[int, np.ndarray] = {}
        for batch in batches:
            x, u = V.matrix(batch.column(2)), V.matrix(batch.column(3))
            out = x.copy()
            for j in np.flatnonzero(live):
                if j not in steps:
                    steps[j] = _binomial_steps(r[j], p[j])
                out[:, j] = np.maximum(x[:, j] + np.searchsorted(steps[j], u[:, j], side="left"), 0.0)
            yield pa.record_batch([batch.column(0), batch.column(1), V.row_lists(out)], names=["anchor_id", "view_no", "vec"])

    views = F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))).alias("view_no")
    rows = dense.select(F.col("cell_id").alias("anchor_id"), views, F.col("vec").cast("array<double>").alias("vec"))
    drawn = rows.withColumn("u", F.transform("vec", lambda _, i: uniform(seed, "noise", F.col("anchor_id"), F.col("view_no"), i)))
    return drawn.mapInArrow(run, "anchor_id bigint, view_no int, vec array<double>")


def gene_dispersion(dense: DataFrame, genes: int, floor: float = 0.01) -> tuple[list[float], list[float]]:
    """Mean and negative-binomial size of every gene: 1 / overdispersion, by moments over all cells."""
    at = lambda i: F.col("vec")[i]
    row = dense.agg(*[f(at(i)) for i in range(genes) for f in (F.avg, F.var_samp)]).first()
    mean = [float(row[2 * i] or 0.0) for i in range(genes)]
    over = [max(((row[2 * i + 1] or 0.0) - m) / (m * m), floor) if m > 0 else floor for i, m in enumerate(mean)]
    return mean, [1.0 / o for o in over]


def mask_views(counts: DataFrame, n_views: int, p: float = 0.2, seed: int = 0) -> DataFrame:
    """Each stored entry is set to zero (dropped) with probability ``p`` in every view."""
    views = counts.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))).alias("view_no"), "gene_id", "x")
    return views.where(uniform(seed, "mask", F.col("cell_id"), F.col("view_no"), F.col("gene_id")) >= p)


def gather_views(views: DataFrame, cells: DataFrame, totals: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns of the viewed cells: size factor, batch, label and its index.

    ``totals(cell_id, sizefactor)``; ``labels(cell_type, label_id)``.
    """
    return (
        views.join(cells, "cell_id")
        .join(totals, "cell_id", "left")
        .join(labels, "cell_type")
        .select("view_no", "anchor_id", "cell_id", F.coalesce("sizefactor", F.lit(0.0)).alias("sizefactor"), "batch", "cell_type", "label_id")
    )


def view_major(views: DataFrame) -> DataFrame:
    """View-major order."""
    return views.orderBy("view_no", "anchor_id")


def anchor_range(views: DataFrame, low: int, high: int) -> DataFrame:
    """Views of anchors in [low, high)."""
    return views.where((F.col("anchor_id") >= low) & (F.col("anchor_id") < high))

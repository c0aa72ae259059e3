"""Nearest-neighbour joins and the graph built from them.

Exact search prunes with pivots: base rows are grouped by nearest pivot, and the
triangle inequality tells which groups can still hold one of a query's k nearest
rows.  Only those groups' tiles meet the query tile.  With ``nprobe`` the same
join visits the nearest groups only, which makes it approximate and linear.
Where a tile would go to more than ``MOST_VISITS`` others, as in many dimensions, nothing is
copied per tile: rows are dealt to a grid of cells, and each base row streams past a cell's queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as V
from ..functions.bounds import MAX_ELEMENTS
from ..functions.rand import uniform
from ..session import cut_lineage
from .rank import top_k
from .tiles import ROWS_PER_TILE, tile_map, unpack

MAX_PIVOTS = 8192
BLOCK = 1 << 20  # row-pivot distances held at once inside a task
MOST_VISITS = 8  # copies of a query tile, on average
SIDE = 8  # blocks of queries and of base rows in the grid: a row is copied that often
QUERIES = 1 << 16  # query rows a cell of the grid holds, about
FAR_ID = np.iinfo(np.int64).max
ZERO = -1  # group of zero vectors under the cosine metric


def _pivot_matrix(base: DataFrame, m: int) -> np.ndarray:
    """``m`` base rows drawn by key: a bounded read (MAX_PIVOTS rows, MAX_ELEMENTS numbers)."""
    width = base.select(F.size("vec")).first()
    if width is not None:
        m = max(1, min(m, MAX_ELEMENTS // max(width[0], 1)))
    rows = base.select("vec").orderBy(uniform("pivot", F.col("cell_id")), "cell_id").limit(m).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def _assign(df: DataFrame, pivots: np.ndarray, cosine: bool) -> DataFrame:
    """Nearest pivot and the distance to it."""

    def near(col: pa.Array) -> pa.Array:
        x = V.matrix(col)
        if len(x) == 0:
            return pa.array([], type=pa.struct([("pivot", pa.int32()), ("d", pa.float64())]))
        step = max(1, BLOCK // len(pivots))
        p = np.concatenate(
            [V.cross_l2sq(x[i : i + step], pivots).argmin(1) for i in range(0, len(x), step)]
        ).astype(np.int32)
        d = np.sqrt(((x - pivots[p]) ** 2).sum(1))
        if cosine:
            p[(x * x).sum(1) == 0] = ZERO
        return pa.StructArray.from_arrays([pa.array(p), pa.array(d)], ["pivot", "d"])

    udf = F.arrow_udf(near, T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("d", T.DoubleType())]))
    return df.withColumn("_p", udf("vec")).select("cell_id", "vec", F.col("_p.pivot").alias("pivot"), F.col("_p.d").alias("d"))


def _visits(df: DataFrame, pivots: np.ndarray, stats: dict, nprobe: int) -> DataFrame:
    """Adds the ``nprobe`` nearest groups of each row, so what a row sees does not depend on its tile."""
    groups = np.array(sorted(p for p in stats if p != ZERO), dtype=np.int32)
    centres = pivots[groups] if len(groups) else np.zeros((0, pivots.shape[1]))

    def near(col: pa.Array) -> pa.Array:
        x = V.matrix(col)
        step = max(1, BLOCK // max(1, len(groups)))
        parts = [groups[np.argsort(V.cross_l2sq(x[i : i + step], centres), axis=1, kind="stable")[:, :nprobe]].tolist() for i in range(0, len(x), step)]
        return pa.array([row for part in parts for row in part], type=pa.list_(pa.int32()))

    return df.withColumn("visits", F.arrow_udf(near, T.ArrayType(T.IntegerType()))("vec"))


def _tile_counts(sizes: dict[int, int], rows_per_tile: int) -> list[int]:
    """Tiles of each group, from ``ZERO`` on."""
    return [max(1, math.ceil(sizes.get(p, 0) / rows_per_tile)) for p in range(ZERO, max(sizes, default=0) + 1)]


def _stats(assigned: DataFrame) -> dict[int, tuple[int, float, float]]:
    """Per pivot group: rows, largest and smallest distance.  At most MAX_PIVOTS + 1 rows."""
    rows = assigned.groupBy("pivot").agg(F.count("*"), F.max("d"), F.min("d")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in rows}


def _pack(assigned: DataFrame, sizes: dict[int, int], rows_per_tile: int, extra: tuple[str, ...] = ()) -> DataFrame:
    count = F.element_at(F.lit(_tile_counts(sizes, rows_per_tile)), F.col("pivot") + F.lit(2))
    salted = assigned.withColumn("salt", F.pmod(F.xxhash64("cell_id"), count.cast("bigint")).cast("int"))
    return salted.groupBy("pivot", "salt").agg(F.collect_list(F.struct("cell_id", "vec", *extra)).alias("rows"))


def _router(pivots, stats, need: int, probing: bool, cosine: bool):
    """Pivot groups each query tile must visit: those some row may need, or that some row asks for."""
    groups = np.array(sorted(p for p in stats if p != ZERO), dtype=np.int64)
    count = np.array([stats[p][0] for p in groups])
    far = np.array([stats[p][1] for p in groups])
    close = np.array([stats[p][2] for p in groups])
    centres = pivots[groups] if len(groups) else np.zeros((0, pivots.shape[1]))
    has_zero = ZERO in stats

    full = count >= need

    def near_groups(x: np.ndarray) -> np.ndarray:
        """Mask of the groups some row of the block needs."""
        d = np.sqrt(V.cross_l2sq(x, centres))
        # all rows of group j lie within d + far[j]: one group with enough rows bounds the k-th distance
        upper = d + far
        if full.any():
            bound = upper[:, full].min(1, keepdims=True)
        else:
            order = np.argsort(upper, axis=1)
            have = np.cumsum(count[order], axis=1) >= need
            ranked = np.take_along_axis(upper, order, 1)
            bound = np.where(have.any(1), ranked[np.arange(len(x)), have.argmax(1)], np.inf)[:, None]
        lower = np.maximum(np.maximum(d - far, close - d), 0.0)
        slack = 1e-7 * (1.0 + d)
        return (lower - slack <= bound).any(0)

    def wanted(x: np.ndarray) -> np.ndarray:
        if not len(groups):
            return groups
        if cosine and ((x * x).sum(1) == 0).any():
            return groups
        step = max(1, BLOCK // len(groups))
        mask = np.zeros(len(groups), dtype=bool)
        for i in range(0, len(x), step):
            mask |= near_groups(x[i : i + step])
        return groups[mask]

    def route(col: pa.Array) -> pa.Array:
        out = []
        for i in range(len(col)):
            rows = col[i].values
            if probing:
                ids = np.unique(np.asarray(rows.field("visits").flatten())).tolist()
            else:
                ids = wanted(unpack(rows)[1]).tolist()
            out.append(ids + [ZERO] if has_zero else ids)
        return pa.array(out, type=pa.list_(pa.int32()))

    return F.arrow_udf(route, T.ArrayType(T.IntegerType()))


def _topk_kernel(k: int, exclude_self: bool, cosine: bool, probing: bool):
    def kernel(row: dict) -> pa.RecordBatch | None:
        qid, q = unpack(row["rows"])
        bid, b = unpack(row["other"])
        if probing and row["to"] != ZERO:
            asked = (np.asarray(row["rows"].field("visits").flatten()).reshape(len(qid), -1) == row["to"]).any(1)
            qid, q = qid[asked], q[asked]
            if not len(qid):
                return None
        src, dst, dist = [], [], []
        step = max(1, (1 << 18) // max(1, len(bid)))
        for s in range(0, len(qid), step):
            qs, ids = q[s : s + step], qid[s : s + step]
            d2 = V.cross_l2sq(qs, b) if not cosine else 1.0 - qs @ b.T
            if exclude_self:
                d2[ids[:, None] == bid[None, :]] = np.inf
            kk = min(k, len(bid))
            kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1 : kk]
            # keep everything within rounding of the k-th, then settle ties on exact values
            scale = 1e-9 * (1.0 + (qs * qs).sum(1, keepdims=True))
            r, c = np.nonzero((d2 <= kth + scale) & np.isfinite(d2))
            if cosine:
                exact = 1.0 - np.einsum("ij,ij->i", qs[r], b[c])
            else:
                exact = ((qs[r] - b[c]) ** 2).sum(1)
            order = np.lexsort((bid[c], exact, r))
            r, c, exact = r[order], c[order], exact[order]
            start = np.searchsorted(r, np.arange(len(ids)))
            keep = np.arange(len(r)) - start[r] < k
            src.append(ids[r[keep]])
            dst.append(bid[c[keep]])
            dist.append(exact[keep])
        return pa.record_batch(
            [pa.array(np.concatenate(src)), pa.array(np.concatenate(dst)), pa.array(np.concatenate(dist))],
            names=["src", "dst", "dist"],
        )

    return kernel


def _grid_found(q: DataFrame, b: DataFrame, pivots: np.ndarray, stats: dict, qsizes: dict, nprobe: int | None, k: int, exclude_self: bool, cosine: bool) -> DataFrame:
    """The grid over all base rows, or with ``nprobe`` one grid per pivot group for the rows that ask for it."""
    if nprobe is None:
        n_queries, n_base = sum(qsizes.values()), sum(s[0] for s in stats.values())
        # over SIDE * QUERIES queries the blocks are more, so that a task holds no more
        across = max(min(SIDE, math.ceil(n_queries / ROWS_PER_TILE)), math.ceil(n_queries / QUERIES), 1)
        along = max(1, min(SIDE, math.ceil(n_base / ROWS_PER_TILE)))
        whole = lambda df: df.select("cell_id", "vec", F.lit(0).alias("to"))
        return _grid(whole(q), whole(b), [1, across], [1, along], k, exclude_self, cosine)
    visits = F.concat("visits", F.array(F.lit(ZERO))) if ZERO in stats else F.col("visits")
    asked = _visits(q, pivots, stats, nprobe).select("cell_id", "vec", F.explode(visits).alias("to"))
    wanted = dict(map(tuple, asked.groupBy("to").count().collect()))  # a row per group
    block = 16 * ROWS_PER_TILE
    count = lambda rows: [max(1, math.ceil(rows.get(p, 0) / block)) for p in range(ZERO, max(stats) + 1)]
    sizes = {p: s[0] for p, s in stats.items()}
    return _grid(asked, b.select("cell_id", "vec", F.col("pivot").alias("to")), count(wanted), count(sizes), k, exclude_self, cosine)


class _Nearest:
    """The queries of one cell of the grid and the best ``k`` of the base rows that have passed them."""

    def __init__(self, k: int, exclude_self: bool, cosine: bool):
        self.k, self.exclude_self, self.cosine = k, exclude_self, cosine
        self.parts, self.ids = [], None

    def ask(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((ids, rows))

    def offer(self, bid: np.ndarray, b: np.ndarray) -> None:
        if not self.parts:
            return
        if self.ids is None:
            self.ids, self.rows = (np.concatenate(p) for p in zip(*self.parts))
            self.dist = np.full((len(self.ids), self.k), np.inf)
            self.dst = np.full((len(self.ids), self.k), FAR_ID)
        for j in range(0, len(bid), 2048):
            for i in range(0, len(self.ids), 512):
                self._meet(slice(i, i + 512), bid[j : j + 2048], b[j : j + 2048])

    def _meet(self, at: slice, bid: np.ndarray, b: np.ndarray) -> None:
        ids, q, k = self.ids[at], self.rows[at], self.k
        d2 = 1.0 - q @ b.T if self.cosine else V.cross_l2sq(q, b)
        if self.exclude_self and np.isin(ids, bid).any():
            d2[ids[:, None] == bid[None, :]] = np.inf
        limit = self.dist[at, k - 1 : k]
        if len(bid) > k and not np.isfinite(limit).all():
            limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1 : k])
        # everything within rounding of the k-th, then exact values settle it
        r, c = np.nonzero((d2 <= limit + 1e-9 * (1.0 + (q * q).sum(1, keepdims=True))) & np.isfinite(d2))
        if not len(r):
            return
        exact = 1.0 - np.einsum("ij,ij->i", q[r], b[c]) if self.cosine else ((q[r] - b[c]) ** 2).sum(1)
        hit, new = np.unique(r, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(hit)), k), new])
        dist = np.concatenate([self.dist[at][hit].ravel(), exact])
        dst = np.concatenate([self.dst[at][hit].ravel(), bid[c]])
        order = np.lexsort((dst, dist, row))
        start = np.searchsorted(row[order], np.arange(len(hit)))
        best = order[start[:, None] + np.arange(k)]
        self.dist[at.start + hit], self.dst[at.start + hit] = dist[best], dst[best]

    def answer(self):
        if self.ids is not None:
            for i in range(0, len(self.ids), 4096):
                found = np.isfinite(self.dist[i : i + 4096])
                src = np.broadcast_to(self.ids[i : i + 4096, None], found.shape)
                columns = (src[found], self.dst[i : i + 4096][found], self.dist[i : i + 4096][found])
                yield pa.record_batch([pa.array(x) for x in columns], names=["src", "dst", "dist"])


def _grid(q: DataFrame, b: DataFrame, qn: list[int], bn: list[int], k: int, exclude_self: bool, cosine: bool) -> DataFrame:
    """Best ``k`` of every cell, from ``q`` and ``b`` ``(cell_id, vec, to)``.

    Group ``to`` is a grid of ``qn`` x ``bn`` cells (listed from ``ZERO`` on).  Sorted by cell, its queries come first and are held;
    base rows stream past in Arrow batches, so a task's memory depends on one block of queries only.
    """
    blocks = lambda n: F.element_at(F.lit(n), F.col("to") + F.lit(2))
    own = lambda n: F.pmod(F.xxhash64("cell_id"), blocks(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    asked = q.withColumn("qs", own(qn)).withColumn("bs", every(bn)).withColumn("side", F.lit(0))
    offered = b.withColumn("bs", own(bn)).withColumn("qs", every(qn)).withColumn("side", F.lit(1))
    cell = ["to", "qs", "bs"]
    both = asked.unionByName(offered).select(*cell, "side", "cell_id", "vec")
    # a grid of one group is few heavy cells, one task each; many groups are spread by their hash
    dealt = both.repartition(*cell) if len(qn) > 2 else both.repartitionById(qn[1] * bn[1], F.col("qs") * F.lit(bn[1]) + F.col("bs"))

    def run(batches):
        held, key = None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(name)) for name in (*cell, "side")], axis=1)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if held is None or key != tuple(keys[start, :3]):
                    if held is not None:
                        yield from held.answer()
                    held, key = _Nearest(k, exclude_self, cosine), tuple(keys[start, :3])
                part = batch.slice(start, end - start)
                put = held.offer if keys[start, 3] else held.ask
                put(np.asarray(part.column("cell_id")), V.matrix(part.column("vec")))
        if held is not None:
            yield from held.answer()

    return dealt.sortWithinPartitions(*cell, "side").mapInArrow(run, "src bigint, dst bigint, dist double")


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "l2sq",
    exclude_self: bool = False,
    nprobe: int | None = None,
    pivots: int | None = None,
    rows_per_tile: int = ROWS_PER_TILE,
    fold_copies: bool | None = None,
) -> DataFrame:
    """k nearest ``base`` rows of every ``queries`` row: ``(src, dst, rank, dist)``.

    ``metric``: ``l2sq``, ``l2`` or ``cosine`` (1 - dot of unit vectors).  Ties go to
    the lower id.  ``exclude_self`` removes the row with the query's own id, which
    stays right when vectors are duplicated.  Tables with many equal vectors are
    folded first (see :func:`_knn_folded`), which an exact search does by itself where it
    saves work: its answer is the same.  ``nprobe`` visits each row's nearest pivot groups only; the
    answer depends on the pivots, not on tiles, and copies are folded only if asked for.
    """
    cosine = metric == "cosine"
    same = queries is base
    prep = lambda df: df.select("cell_id", (V.unit_kernel()("vec") if cosine else V.to_double("vec")).alias("vec"))
    queries, base = prep(queries), prep(base)
    if pivots is None or fold_copies is None:
        facts = base.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("vec"), 0.02)).first()
        pivots = pivots or min(MAX_PIVOTS, math.ceil(facts[0] / rows_per_tile))
        fold_copies = nprobe is None and facts[1] < 0.8 * facts[0] if fold_copies is None else fold_copies
    if fold_copies:
        args = dict(metric=metric, nprobe=nprobe, pivots=pivots, rows_per_tile=rows_per_tile)
        return _knn_folded(queries, base, k, exclude_self, args)
    centre = _pivot_matrix(base, max(1, min(pivots, MAX_PIVOTS)))
    schema = "src bigint, dst bigint, dist double"
    if not len(centre):
        return queries.sparkSession.createDataFrame([], "src bigint, dst bigint, rank int, dist double")
    probing = nprobe is not None
    b = cut_lineage(_assign(base, centre, cosine))
    stats = _stats(b)
    sizes = {p: s[0] for p, s in stats.items()}
    q = b if same else cut_lineage(_assign(queries, centre, cosine))
    qsizes = sizes if same else {p: s[0] for p, s in _stats(q).items()}
    bt = _pack(b, sizes, rows_per_tile)
    qt = _pack(_visits(q, centre, stats, nprobe), qsizes, rows_per_tile, ("visits",)) if probing else bt if same else _pack(q, qsizes, rows_per_tile)
    route = _router(centre, stats, k + int(exclude_self), probing, cosine)
    routed = qt.select("rows", F.explode(route("rows")).alias("to"))
    # a group of any size is as many addresses as it has tiles
    last = F.element_at(F.lit(_tile_counts(sizes, rows_per_tile)), F.col("to") + F.lit(2)) - 1
    tiles = sum(_tile_counts(sizes, rows_per_tile))
    asking = sum(_tile_counts(qsizes, rows_per_tile))
    if tiles > MOST_VISITS and routed.agg(F.sum(last + 1)).first()[0] > MOST_VISITS * asking:
        found = _grid_found(q, b, centre, stats, qsizes, nprobe, k, exclude_self, cosine)
    else:
        addressed = routed.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
        target = bt.select(F.col("pivot").alias("to"), F.col("salt").alias("at"), F.col("rows").alias("other"))
        # sizes are estimated before the explode: a side that looks small could be broadcast with all its copies
        pairs = addressed.hint("merge").join(target, ["to", "at"]).select("to", "rows", "other")
        found = tile_map(pairs, _topk_kernel(k, exclude_self, cosine, probing), schema)
    best = top_k(found, ["src"], [F.asc("dist"), F.asc("dst")], k)
    if metric == "l2":
        best = best.withColumn("dist", F.sqrt("dist"))
    return best.select("src", "dst", "rank", "dist")


def _knn_folded(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool, args: dict) -> DataFrame:
    """The same join when many vectors are equal, without pairing the copies.

    Ties go to the lowest ids, so of a group of equal base vectors only the lowest
    ``k`` (+ 1 for a removed self) can ever be answered; and equal queries share one
    answer but for the removed self.  Both reductions are exact: limits per group are
    applied before the shuffle, and one bounded list is joined back to all copies.
    """
    need = k + int(exclude_self)
    keyed = lambda df: df.withColumn("_h", F.xxhash64("vec"))
    kept = top_k(keyed(base), ["_h", "vec"], [F.asc("cell_id")], need, "_c").select("cell_id", "vec")
    heads = keyed(queries).groupBy("_h", "vec").agg(F.min("cell_id").alias("cell_id"))
    found = knn_join(heads.select("cell_id", "vec"), kept, need, fold_copies=False, **args)
    lists = found.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist"))).alias("_n"))
    answers = heads.join(lists, F.col("cell_id") == F.col("src")).select("_h", "vec", "_n")
    every = keyed(queries).join(answers, ["_h", "vec"])
    near = F.filter("_n", lambda e: e["dst"] != F.col("cell_id")) if exclude_self else F.col("_n")
    return every.select(F.col("cell_id").alias("src"), F.posexplode(F.slice(near, 1, k)).alias("_i", "_e")).select(
        "src", F.col("_e.dst").alias("dst"), (F.col("_i") + 1).alias("rank"), F.col("_e.dist").alias("dist")
    )


def knn_graph(df: DataFrame, k: int, metric: str = "l2sq", **kw) -> DataFrame:
    """Each row's k nearest other rows."""
    return knn_join(df, df, k, metric, exclude_self=True, **kw)


def knn_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of true edges that were found."""
    hit = truth.select("src", "dst").join(found.select("src", "dst", F.lit(1).alias("_h")), ["src", "dst"], "left")
    return hit.agg(F.avg(F.coalesce("_h", F.lit(0))).alias("recall"))


def undirected_edges(knn: DataFrame) -> DataFrame:
    """Each undirected edge once, ``a < b``."""
    return knn.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).dropDuplicates()


def both_directions(edges: DataFrame) -> DataFrame:
    """Every undirected edge in both directions, from one evaluation of ``edges``."""
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return edges.select(F.explode(ways).alias("_e")).select("_e.src", "_e.dst")


def restrict_graph(knn: DataFrame, nodes: DataFrame, filter_src: bool = False) -> DataFrame:
    """Keep edges into ``nodes`` (and, as an option, out of them)."""
    kept = knn.join(nodes.select(F.col("cell_id").alias("dst")), "dst", "left_semi")
    if filter_src:
        kept = kept.join(nodes.select(F.col("cell_id").alias("src")), "src", "left_semi")
    return kept


def same_label_fraction(edges: DataFrame, cells: DataFrame, label: str = "cell_type") -> DataFrame:
    """Share of a cell's neighbours that carry its label, averaged per label."""
    a = cells.select(F.col("cell_id").alias("src"), F.col(label).alias("_a"))
    b = cells.select(F.col("cell_id").alias("dst"), F.col(label).alias("_b"))
    tagged = edges.join(a, "src").join(b, "dst")
    per_cell = tagged.groupBy("src", "_a").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("_f"))
    return per_cell.groupBy(F.col("_a").alias(label)).agg(
        F.avg("_f").alias("same_label_fraction"), F.count("*").alias("n_cells")
    )


def same_label_per_cell(edges: DataFrame, cells: DataFrame, label: str = "cell_type") -> DataFrame:
    a = cells.select(F.col("cell_id").alias("src"), F.col(label).alias("_a"))
    b = cells.select(F.col("cell_id").alias("dst"), F.col(label).alias("_b"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("cell_id")).agg(
        F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("fraction")
    )


def community_purity(members: DataFrame, community: str = "community", label: str = "cell_type") -> DataFrame:
    """Size, majority label, purity and size-weighted purity of each community."""
    counts = members.groupBy(community, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(community).agg(
        F.sum("_n").alias("size"),
        F.min_by(label, F.struct(F.negative("_n"), F.col(label))).alias("majority"),
        (F.max("_n") / F.sum("_n")).alias("purity"),
        F.max("_n").alias("weighted_purity"),
    ).withColumn("weighted_purity", F.col("purity") * F.col("size"))

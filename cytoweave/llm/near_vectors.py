"""Near-duplicate vectors by sorted projection passes.

Every pass gives a vector a key, the concatenated signs of its products with random directions, sorts each label's vectors
by key over the whole cluster, and compares each with the ``window`` vectors before it.  Pairs that are as similar as asked for
are united over all passes.  Two vectors at angle t share the first L signs with chance (1 - t/pi)^L, and about ``window`` of n
vectors share the first log2(n / window) signs; so the number of passes follows from the largest label, the window and
the share of pairs that may be missed at the threshold itself.

A window is bounded, so in a dense group most links are not seen by it.  They are counted afterwards, exactly, between all members of a
component: members are cut into tiles, a pair of tiles is decided by the tiles' centres and radii where that is possible, and
compared vector by vector where it is not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..session import cut_lineage, scratch_path, ship_package
from .common import free_name

WINDOW = 512
STEP = 512  # rows compared with their window at once
BITS = 62
RECALL = 0.999
ROWS_PER_TILE = 512
TILES_PER_PACK = 256
SLACK = 1e-6  # angles closer to the border than this are compared vector by vector
NODE = "struct<id:bigint,h:bigint>"
SORTED = f"a {NODE}, b {NODE}, part int, pos bigint, grp string, vec array<double>"


def unit_vectors(vec_col: str) -> Column:
    """Unit vector in doubles; null for a vector that is null, empty, zero, or holds null or non-finite components."""

    def units(column: pa.Array) -> pa.Array:
        out = []
        for v in column:
            v = v.values
            x = None if v is None or v.null_count or not len(v) else np.asarray(v, dtype=np.float64)
            if x is not None:
                top = np.abs(x).max()
                x = None if not np.isfinite(top) or top == 0 else x / top
            out.append(None if x is None else x / np.sqrt(x @ x))
        return pa.array(out, type=pa.list_(pa.float64()))

    return F.arrow_udf(units, T.ArrayType(T.DoubleType()))(F.col(vec_col).cast("array<double>"))


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold is missed with a chance of at most ``1 - recall``, with n evenly spread vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    meet = agree ** max(0.0, math.log2(max(1, n) / window)) * agree
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def keyed(number: int, seed: int):
    """Arrow function: the key of pass ``number``, of ``BITS`` signs, most significant first."""

    def signs(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), dtype=np.int64)
        counts = np.diff(np.asarray(column.offsets))
        flat, starts = np.asarray(column.flatten()), np.cumsum(counts) - counts
        for d in np.unique(counts):
            rows = np.flatnonzero(counts == d)
            directions = np.random.default_rng([seed, number, int(d)]).standard_normal((int(d), BITS))
            x = flat[starts[rows][:, None] + np.arange(d)]
            out[rows] = ((x @ directions) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        return pa.array(out)

    return F.arrow_udf(signs, T.LongType())


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs (a, b) of 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def close_pairs(x: np.ndarray, group: np.ndarray, first: int, reach: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``j < i`` with ``i >= first``, ``i - j <= reach``, equal groups and a cosine of at least ``threshold``."""
    i = np.arange(first, len(x))[:, None]
    j = np.arange(len(x))[None, :]
    hit = (x[first:] @ x.T >= threshold) & (j < i) & (i - j <= reach) & (group[first:, None] == group[None, :])
    r, c = np.nonzero(hit)
    return r + first, c


def forest(x: np.ndarray, group: np.ndarray, first: int, reach: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their roots: edges that connect all that these pairs connect, one per row at most, however dense a group is."""
    root = local_roots(len(x), *close_pairs(x, group, first, reach, threshold))
    tied = np.flatnonzero(root != np.arange(len(x)))
    return tied, root[tied]


def padded(column: pa.Array) -> np.ndarray:
    """Vectors as rows of one matrix; shorter ones end in zeros (vectors of different length are never in one group)."""
    counts = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), int(counts.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < counts[:, None]] = np.asarray(column.flatten())
    return out


def stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = max(a.shape[1], b.shape[1])
    return np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b)])


def _nodes(ids, h) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(h, pa.int64())], ["id", "h"])


def _sorted_batch(n: int, **columns) -> pa.RecordBatch:
    node = pa.struct([("id", pa.int64()), ("h", pa.int64())])
    kinds = {"a": node, "b": node, "part": pa.int32(), "pos": pa.int64(), "grp": pa.string(), "vec": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def _scan(window: int, threshold: float):
    """Sorted rows ``(id, h, grp, vec)`` of a partition: edges inside it, its first and last ``window`` rows, its length."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None  # the last rows, for the next step's window and the border
        pos = 0
        number = lambda n, x: pa.array(np.full(n, x), pa.int64())

        def border(rows: pa.RecordBatch, at: int) -> pa.RecordBatch:
            n = rows.num_rows
            return _sorted_batch(n, a=_nodes(rows.column("id"), rows.column("h")), part=number(n, part), pos=pa.array(np.arange(at, at + n)), grp=rows.column("grp"), vec=rows.column("vec"))

        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                step = batch.slice(start, STEP)
                if pos < window:
                    yield border(step.slice(0, window - pos), pos)
                x = padded(step.column("vec"))
                first = 0
                if held is not None:
                    first = held.num_rows
                    x = stacked(padded(held.column("vec")), x)
                    step = pa.Table.from_batches([held, step]).combine_chunks().to_batches()[0]
                group = step.column("grp").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                tied, root = forest(x, group, first, window, threshold)
                if len(tied):
                    ids, h = step.column("id").to_numpy(), step.column("h").to_numpy()
                    yield _sorted_batch(len(tied), a=_nodes(ids[tied], h[tied]), b=_nodes(ids[root], h[root]))
                pos += step.num_rows - first
                held = step.slice(max(0, step.num_rows - window))
        if held is not None:
            new = min(held.num_rows, pos - window)  # rows of the end that were not among the first ones
            if new > 0:
                yield border(held.slice(held.num_rows - new), pos - new)
            yield _sorted_batch(1, part=number(1, part), pos=number(1, pos))

    return run


def _borders(scanned: DataFrame, window: int, threshold: float) -> DataFrame | None:
    """Edges between neighbours that the cut into partitions has parted; one number per partition is read by the driver."""
    sizes = sorted((r["part"], r["pos"]) for r in scanned.where("a is null").select("part", "pos").collect())
    if len(sizes) < 2:
        return None
    start = np.cumsum([0, *[n for _, n in sizes]])[:-1]
    offset = dict(zip((p for p, _ in sizes), start.tolist()))

    def deal(batches):
        for batch in batches:
            part, pos = batch.column("part").to_numpy(), batch.column("pos").to_numpy()
            rank = pos + np.array([offset[p] for p in part.tolist()], dtype=np.int64)
            low, high = np.searchsorted(start, rank - window, "right"), np.searchsorted(start, rank + window, "right")
            low = np.maximum(low, 1)
            times = np.maximum(high - low, 0)
            row = np.repeat(np.arange(len(rank)), times)
            border = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(len(row))
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(border.astype(np.int32)), pa.array(rank[row]), *[taken.column(c) for c in ("a", "grp", "vec")]], ["border", "rank", "a", "grp", "vec"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        rows = table.to_batches()[0]
        first = int((rows.column("rank").to_numpy() < start[rows.column("border")[0].as_py()]).sum())
        group = rows.column("grp").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        tied, root = forest(padded(rows.column("vec")), group, first, window, threshold)
        return pa.table({"a": rows.column("a").take(pa.array(tied)), "b": rows.column("a").take(pa.array(root))})

    rows = scanned.where("a is not null and b is null").select("part", "pos", "a", "grp", "vec")
    dealt = rows.mapInArrow(deal, f"border int, rank bigint, a {NODE}, grp string, vec array<double>")
    return dealt.groupBy("border").applyInArrow(meet, f"a {NODE}, b {NODE}")


def window_edges(vectors: DataFrame, threshold: float, passes: int, window: int, partitions: int, seed: int) -> DataFrame:
    """``(a, b)`` over ``vectors(node, grp, vec)`` (written, distinct): edges that connect what the windows of all passes link."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "passes")
    found = []
    for number in range(passes):
        flat = vectors.select("node.id", "node.h", "grp", "vec", keyed(number, seed)("vec").alias("key"))
        order = ["grp", "key", "id", "h"]
        ordered = flat.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("id", "h", "grp", "vec")
        ordered.mapInArrow(_scan(window, threshold), SORTED).write.parquet(f"{path}/{number}")
        scanned = spark.read.schema(SORTED).parquet(f"{path}/{number}")
        found.append(scanned.where("b is not null").select("a", "b"))
        crossing = _borders(scanned, window, threshold)
        if crossing is not None:
            found.append(crossing)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionAll(more)
    return edges


def _angles(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1.0, 1.0))


def _summaries(batches):
    """Weight, centre and radius of every tile."""
    for batch in batches:
        n = batch.num_rows
        weight, centre, radius = [], [], []
        for i in range(n):
            rows = batch.column("rows")[i].values
            x = padded(rows.field("vec"))
            mean = x.mean(0)
            size = np.sqrt(mean @ mean)
            mean = mean / size if size > 1e-6 else x[0]
            weight.append(int(np.asarray(rows.field("copies")).sum()))
            centre.append(mean)
            radius.append(float(_angles(x @ mean).max()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("component", "tile", "tiles")], pa.array(weight), pa.array(centre, pa.list_(pa.float64())), pa.array(radius)], ["component", "tile", "tiles", "weight", "centre", "radius"])


def _decide(threshold: float):
    """Pairs of tiles: linked as a whole (``other`` null, ``weight`` to add), not at all, or to be compared (``other`` set)."""
    border = math.acos(threshold)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("left")[i].values, batch.column("right")[i].values
                same = batch.column("pack")[i].as_py() == batch.column("to")[i].as_py()
                (s, w, c, r), (t, v, d, q) = ((np.asarray(x.field("tile")), np.asarray(x.field("weight")), padded(x.field("centre")), np.asarray(x.field("radius"))) for x in (left, right))
                angle, reach = _angles(c @ d.T), r[:, None] + q[None, :]
                if same:
                    angle[s[:, None] == t[None, :]] = 0.0
                wanted = s[:, None] <= t[None, :] if same else np.ones(angle.shape, dtype=bool)
                whole = wanted & (angle + reach <= border - SLACK)
                open_ = wanted & ~whole & (angle - reach <= border + SLACK)
                add = {int(x): 0 for x in [*s, *t]}
                for x, y in zip(*np.nonzero(whole)):
                    add[int(s[x])] += int(v[y])
                    if s[x] != t[y]:
                        add[int(t[y])] += int(w[x])
                given = [(k, None, n) for k, n in add.items() if n] + [(int(s[x]), int(t[y]), None) for x, y in zip(*np.nonzero(open_))]
                if given:
                    tile, other, weight = zip(*given)
                    component = pa.array([batch.column("component")[i].as_py()] * len(given), type=batch.column("component").type)
                    yield pa.RecordBatch.from_arrays([component, pa.array(tile, pa.int64()), pa.array(other, pa.int64()), pa.array(weight, pa.int64())], ["component", "tile", "other", "weight"])

    return run


def _compare(threshold: float):
    """Links of every vector of an open pair of tiles, counted with copies."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("rows")[i].values, batch.column("others")[i].values
                same = batch.column("tile")[i].as_py() == batch.column("other")[i].as_py()
                hit = padded(left.field("vec")) @ padded(right.field("vec")).T >= threshold
                if same:
                    np.fill_diagonal(hit, True)
                yield pa.RecordBatch.from_arrays([left.field("node"), pa.array(hit @ np.asarray(right.field("copies")))], ["node", "n"])
                if not same:
                    yield pa.RecordBatch.from_arrays([right.field("node"), pa.array(np.asarray(left.field("copies")) @ hit)], ["node", "n"])

    return run


def deal_tiles(found: DataFrame, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """``found(node, component)`` with ``tiles``, how many its component is cut into, and ``tile``, the one this node is in.

    Done before vectors are joined on the node, so that they go straight to (component, tile) and no component is a key of theirs.
    """
    tiles = found.groupBy("component").agg(F.ceil(F.count("*") / rows_per_tile).alias("tiles"))
    return found.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))


def count_links(members: DataFrame, threshold: float, tiles_per_pack: int = TILES_PER_PACK) -> DataFrame:
    """``(node, n)`` for ``members(component, tile, tiles, node, copies, vec)``: rows linked with each vector inside its component, itself and its copies counted.

    Exact.  A tight group of any size is settled by its tiles' summaries; vectors travel only for pairs of tiles that the summaries
    leave open.
    """
    packed = cut_lineage(members.groupBy("component", "tile").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct("node", "copies", "vec")).alias("rows")))
    summary = packed.mapInArrow(_summaries, f"component {NODE}, tile bigint, tiles bigint, weight bigint, centre array<double>, radius double")
    pack = F.floor(F.col("tile") / tiles_per_pack)
    packs = summary.groupBy("component", pack.alias("pack")).agg(F.floor((F.first("tiles") - 1) / tiles_per_pack).alias("last"), F.collect_list(F.struct("tile", "weight", "centre", "radius")).alias("left"))
    packs = cut_lineage(packs)
    routed = packs.withColumn("to", F.explode(F.sequence("pack", "last")))
    pairs = routed.join(packs.select("component", F.col("pack").alias("to"), F.col("left").alias("right")), ["component", "to"])
    decided = cut_lineage(pairs.select("component", "pack", "to", "left", "right").mapInArrow(_decide(threshold), f"component {NODE}, tile bigint, other bigint, weight bigint"))
    whole = decided.where("other is null").groupBy("component", "tile").agg(F.sum("weight").alias("weight"))
    known = packed.join(whole, ["component", "tile"]).select(F.explode("rows.node").alias("node"), F.col("weight").alias("n"))
    left = decided.where("other is not null").select("component", "tile", "other").join(packed.select("component", "tile", "rows"), ["component", "tile"])
    both = left.join(packed.select("component", F.col("tile").alias("other"), F.col("rows").alias("others")), ["component", "other"])
    compared = both.select("tile", "other", "rows", "others").mapInArrow(_compare(threshold), f"node {NODE}, n bigint")
    return known.unionAll(compared).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    window: int = WINDOW,
    recall: float = RECALL,
    passes: int | None = None,
    partitions: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``; input columns of these names give way.

    Two rows with equal, non-null labels link if the cosine of their vectors is at least ``threshold``.  ``n_links`` counts the other rows
    linked with a row, ``component_id`` is the smallest id reachable, ``kept`` is true where that is the row's own id.  A vector that
    is null, empty, zero, or holds null or non-finite components links with nothing, nor do vectors of different length.
    Links are never wrong.  A pair can be missed only if no pass brings it, nor a chain of links around it, into one window: with the number of
    passes taken from ``recall`` that has a chance of at most ``1 - recall`` for a lone pair right at the threshold among evenly
    spread vectors, and less for closer ones.  Within a component every link is counted.  Rows with a null id take
    part, and lend their component an id only if nothing else does; rows that repeat an id are vectors of their own.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vectors = vectors.drop("n_links", "component_id", "kept")
    unit, grp, hashed = (free_name(vectors, c) for c in ("_unit", "_grp", "_hash"))
    rows = vectors.withColumn(unit, unit_vectors(vec_col))
    # rows of one group have equal labels and equally long vectors; null: links with nothing
    rows = rows.withColumn(grp, F.when(F.col(unit).isNotNull() & F.col(label_col).isNotNull(), F.concat(F.size(unit).cast("string"), F.lit(":"), F.col(label_col).cast("string"))))
    rows = rows.withColumn(hashed, F.xxhash64(grp, unit))
    valid = rows.where(F.col(grp).isNotNull()).select(F.col(id_col).cast("bigint").alias("own"), F.col(grp).alias("grp"), F.col(hashed).alias("h"), F.col(unit).alias("vec"))
    folded = valid.groupBy("grp", "h", "vec").agg(F.min("own").alias("low"), F.count("*").alias("copies"))
    node = F.struct(F.coalesce("low", F.xxhash64(F.lit(1), "grp", "vec")).alias("id"), F.col("h"))
    folded = cut_lineage(folded.select(node.alias("node"), "low", "copies", "grp", "vec"))
    if passes is None:
        largest = folded.groupBy("grp").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        passes = passes_for(largest, threshold, window, recall)
    # windows that reach over many partitions are only work done twice
    partitions = partitions or min(int(spark.conf.get("spark.sql.shuffle.partitions")), folded.count() // (4 * window) + 1)
    found = components(window_edges(folded.select("node", "grp", "vec"), threshold, passes, window, partitions, seed))
    dealt = cut_lineage(deal_tiles(found))
    members = cut_lineage(dealt.join(folded, "node").select("component", "tile", "tiles", "node", "copies", "low", "vec"))
    linked = count_links(members.drop("low"), threshold)
    lowest = members.groupBy("component").agg(F.min("low").alias("lowest"))
    known = members.select("component", "node").join(linked, "node").join(lowest, "component").select("node", "n", "lowest")
    g, h, v, low, n = (free_name(rows, c) for c in ("_g", "_h", "_v", "_low", "_n"))
    answer = folded.join(known, "node", "left").select(
        F.col("grp").alias(g),
        F.col("node.h").alias(h),
        F.col("vec").alias(v),
        (F.coalesce("n", "copies") - 1).alias(n),
        F.when(F.col("n").isNull(), F.col("low")).otherwise(F.col("lowest")).alias(low),
    )
    same = (F.col(grp) == F.col(g)) & (F.col(hashed) == F.col(h)) & (F.col(unit) == F.col(v))
    own = F.col(id_col).cast("bigint")
    component = F.when(F.col(g).isNull(), own).otherwise(F.col(low))
    links = F.coalesce(F.col(n), F.lit(0)).cast("bigint")
    columns = [F.col(f"`{c}`") for c in vectors.columns]
    return rows.join(answer, same, "left").select(*columns, links.alias("n_links"), component.alias("component_id"), own.eqNullSafe(component).alias("kept"))

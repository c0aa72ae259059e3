"""Components and communities by iterated joins on an edge table.

Each round is checkpointed to the shared folder, so plans stay short and lost
executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform
from ..session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links(a, b)``: the smallest node reachable.

    Contraction: every node points at its smallest neighbour (a partial aggregate, so hubs are
    cheap), pointers are doubled, and edges move to what their ends point at; loops and repeats
    go.  Every round at least halves the nodes of a component, so rounds are logarithmic in its
    size.  The rounds are then read backwards to carry the final label to all nodes.  Joins are on
    nodes that occur once on one side, so a hub is split like any skewed join.  Null ends are dropped.
    """
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.where("a is not null and b is not null").select(F.explode(ways).alias("_e")).select("_e.a", "_e.b")
    edges = cut_lineage(both.where("a <> b").distinct())
    loops = cut_lineage(links.where("a = b").select(F.col("a").alias("node")).distinct())
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        up = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("to")))
        further = up.select(F.col("node").alias("to"), F.col("to").alias("_far"))
        up = cut_lineage(up.join(further, "to").select("node", F.col("_far").alias("to")))
        pointers.append(up)
        to_a = up.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        to_b = up.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        moved = edges.join(to_a, "a").select("_a", "b").distinct().join(to_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges = cut_lineage(moved.where("a <> b").distinct())
    if not pointers:
        return loops.select("node", F.col("node").alias("component"))
    label = pointers[-1].select("node", F.col("to").alias("component"))
    for up in reversed(pointers[:-1]):
        known = label.select(F.col("node").alias("to"), "component")
        label = cut_lineage(up.join(known, "to", "left").select("node", F.coalesce("component", "to").alias("component")))
    return label.unionAll(loops.join(label, "node", "left_anti").select("node", F.col("node").alias("component")))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(cell_id, component)``: the smallest id reachable over undirected ``edges(src, dst)``; a node without edges is its own."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = found.select(F.col("node").alias("cell_id"), "component")
    return nodes.select("cell_id").join(named, "cell_id", "left").select("cell_id", F.coalesce("component", "cell_id").alias("component"))


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of a partition; ``edges(src, dst, w)`` holds both directions."""
    label = members.select(F.col("cell_id").alias("_id"), "community")
    tagged = edges.join(label.withColumnRenamed("community", "_cs").withColumnRenamed("_id", "src"), "src").join(
        label.withColumnRenamed("community", "_cd").withColumnRenamed("_id", "dst"), "dst"
    )
    per = tagged.groupBy(F.col("_cs").alias("community")).agg(
        F.sum("w").alias("k"), F.sum(F.when(F.col("_cs") == F.col("_cd"), F.col("w")).otherwise(0.0)).alias("inside")
    )
    m2 = per.agg(F.sum("k")).scalar()
    return per.agg(
        F.sum(F.col("inside") / m2 - F.lit(resolution) * F.pow(F.col("k") / m2, F.lit(2.0))).alias("modularity"),
        F.count("*").alias("n_communities"),
    )


LEAST_GAIN = 1e-10  # share of all edge weight that a move has to win; every round wins as much, so rounds end
SALTS = 16
MOVING = 0.75  # share of the nodes that want to move and do so in a round
SETTLED = 1e-3  # a level ends when a round raises modularity by less; the last one goes on until nothing wants to move


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 0, refine: bool = True) -> DataFrame:
    """``(cell_id, community)`` of high modularity; every community is connected by its own edges.

    ``edges(src, dst, w)`` holds both directions.  A level moves nodes between communities until no move gains
    (:func:`_local_moves`), then builds every community up again from single nodes that are well connected to it
    (:func:`_refined`).  The refined parts become the nodes of the next level, which starts from the unrefined
    communities: nothing that was won is lost, and a part can still leave a community that it was in by accident.
    Levels end when refinement merges nothing; each one before has fewer nodes than the last.  What is left are communities
    of one part, or of parts without use for each other; the latter are cut into their components, which
    never costs modularity.  ``refine=False`` folds whole communities instead.  A node without edges is a community of its own.
    """
    edges = cut_lineage(edges.where("w > 0").select("src", "dst", F.col("w").cast("double").alias("w")))
    m2 = edges.agg(F.sum("w")).first()[0]
    alone = nodes.select("cell_id", F.col("cell_id").alias("community"))
    if not m2:
        return alone
    original = edges
    members = alone.select("cell_id", F.col("community").alias("part"))
    start = None
    level = 0
    while True:
        units = cut_lineage(edges.groupBy(F.col("src").alias("cell_id")).agg(F.sum("w").alias("k")))
        first = units.select("cell_id", F.col("cell_id").alias("community")) if start is None else start
        moved = _local_moves(units, edges, first, m2, resolution, seed + level, SETTLED if refine else 0.0)
        parts = _refined(units, edges, moved, m2, resolution, seed + level) if refine else moved.withColumnRenamed("community", "part")
        step = parts.select(F.col("cell_id").alias("_c"), F.col("part").alias("_to"))
        if parts.where("part <> cell_id").isEmpty():
            last = _local_moves(units, edges, moved, m2, resolution, seed + level, 0.0) if refine else moved
            parts = _refined(units, edges, last, m2, resolution, seed + level) if refine else parts
            moved = last
            if parts.where("part <> cell_id").isEmpty():
                break
            step = parts.select(F.col("cell_id").alias("_c"), F.col("part").alias("_to"))
        members = cut_lineage(members.join(step, F.col("part") == F.col("_c"), "left").select("cell_id", F.coalesce("_to", "part").alias("part")))
        a = step.select(F.col("_c").alias("src"), F.col("_to").alias("_s"))
        b = step.select(F.col("_c").alias("dst"), F.col("_to").alias("_d"))
        edges = cut_lineage(edges.join(a, "src").join(b, "dst").groupBy(F.col("_s").alias("src"), F.col("_d").alias("dst")).agg(F.sum("w").alias("w")))
        # all parts of a community start in it; its name is the smallest of them
        named = parts.join(moved, "cell_id").groupBy("community").agg(F.min("part").alias("_name"))
        start = cut_lineage(parts.join(moved, "cell_id").select("part", "community").distinct().join(named, "community").select(F.col("part").alias("cell_id"), F.col("_name").alias("community")))
        level += 1
    last = moved.select(F.col("cell_id").alias("_c"), "community")
    found = cut_lineage(members.join(last, F.col("part") == F.col("_c"), "left").select("cell_id", F.coalesce("community", "part").alias("community")))
    return connected_parts(found, original) if refine else found


def connected_parts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``(cell_id, community)``: every community cut into what its own edges connect, named by the smallest member."""
    a = members.select(F.col("cell_id").alias("src"), F.col("community").alias("_a"))
    b = members.select(F.col("cell_id").alias("dst"), F.col("community").alias("_b"))
    inside = edges.where("src < dst").join(a, "src").join(b, "dst").where("_a = _b")
    return connected_components(members, inside).select("cell_id", F.col("component").alias("community"))


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``key``; a key that many rows share is dealt over salts."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def _best_on_both_sides(proposals: DataFrame, left: str, right: str) -> DataFrame:
    """The proposals that gain most of all that touch their ``left`` and their ``right`` group: no group is in two of them.

    There is at least one if there are proposals at all, and gains of proposals without a common group add up.
    """
    rank = F.struct(F.col("gain"), F.col("cell_id"))
    best = proposals.select(F.explode(F.array(F.col(left), F.col(right))).alias("_g"), rank.alias("_r")).groupBy("_g").agg(F.max("_r").alias("_r"))
    ends = [best.select(F.col("_g").alias(side), F.col("_r").alias(f"_{side}")) for side in (left, right)]
    both = proposals.withColumn("_own", rank).join(ends[0], left).join(ends[1], right)
    return both.where(F.col("_own").eqNullSafe(F.col(f"_{left}")) & F.col("_own").eqNullSafe(F.col(f"_{right}"))).select(*proposals.columns)


def _local_moves(units: DataFrame, edges: DataFrame, start: DataFrame, m2: float, resolution: float, seed: int, settled: float) -> DataFrame:
    """``(cell_id, community)`` from ``start`` on, until no single move gains, or a round gains less than ``settled``.

    Each round asks every node for the neighbouring community with the largest gain over staying,
    ``w(i, c) - resolution * k_i * K_c / 2m``, and moves a keyed share of those that want to.  Moves made at once can
    spoil each other, so modularity is read off the next round's table; if it has not risen, the round is taken back
    and only moves without a common community are made, whose gains add up.  So modularity rises by a least amount with
    every round, and as it is bounded the rounds end.
    """
    links = edges.where("src <> dst")
    loops = edges.where("src = dst").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    least = LEAST_GAIN * m2
    state, taken_back, reached = start, None, None
    r = 0
    while True:
        own = state.join(units, "cell_id").select(F.col("cell_id").alias("src"), F.col("community").alias("mine"), "k")
        near = links.join(state.select(F.col("cell_id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
        stay = own.select("src", F.col("mine").alias("community"), F.lit(0.0).alias("w"))
        options = near.unionAll(stay).groupBy("src", "community").agg(F.sum("w").alias("w"))
        mass = own.groupBy(F.col("mine").alias("community")).agg(F.sum("k").alias("mass"))
        at_home = F.col("community") == F.col("mine")
        gain = F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(at_home, F.col("k")).otherwise(0.0)) / m2
        # rounding keeps the choice independent of summation order; the lowest id wins a tie
        asked = _looked_up(options.join(own, "src"), mass, "community").withColumn("gain", gain).groupBy(F.col("src").alias("cell_id")).agg(
            F.first("mine").alias("mine"),
            F.min_by("community", F.struct(F.negative(F.round(F.col("gain") / m2, 13)), F.col("community"))).alias("to"),
            (F.max("gain") - F.max(F.when(at_home, F.col("gain")))).alias("gain"),
            F.max(F.when(at_home, F.col("w"))).alias("inside"),
            F.max(F.when(at_home, F.col("k") * F.col("mass") / m2)).alias("expected"),
        )
        wants = (F.col("gain") > least) & (F.col("to") != F.col("mine"))
        asked = cut_lineage(asked.withColumn("wants", wants).withColumn("heads", wants & (uniform(seed, "move", r, F.col("cell_id")) < MOVING)))
        inside, expected, wanting, moving = asked.agg(F.sum("inside"), F.sum("expected"), F.count(F.when(F.col("wants"), 1)), F.count(F.when(F.col("heads"), 1))).first()
        value = inside + loops - resolution * expected
        if taken_back is not None and value <= reached + least:
            state, taken_back = _apart(taken_back), None
            continue
        if not wanting or reached is not None and value <= reached + settled * m2:
            return state
        reached, taken_back = value, asked if moving else None
        state = asked.select("cell_id", F.when(F.col("heads"), F.col("to")).otherwise(F.col("mine")).alias("community")) if moving else _apart(asked)
        r += 1


def _apart(asked: DataFrame) -> DataFrame:
    """Of the moves that nodes want, those without a common community are made."""
    moves = _best_on_both_sides(asked.where("wants").select("cell_id", "mine", "to", "gain"), "mine", "to").select("cell_id", F.col("to").alias("_to"))
    return cut_lineage(asked.join(moves, "cell_id", "left").select("cell_id", F.coalesce("_to", "mine").alias("community")))


def _refined(units: DataFrame, edges: DataFrame, moved: DataFrame, m2: float, resolution: float, seed: int) -> DataFrame:
    """``(cell_id, part)``: every community of ``moved`` built up again from single nodes, inside itself.

    A part is well connected if its edges to the rest of the community weigh at least ``resolution * K_part * (K_rest) / 2m``.
    In a round a keyed half of the parts of one node look for the part of the other half that gains most, both being well
    connected, and join it; if the halves have no such pair but others do, the pairs that are best for both sides
    join.  A node only joins a part that it has an edge to and that stays where it is, so parts are connected.
    """
    least = LEAST_GAIN * m2
    tagged = moved.select("cell_id", "community")
    a = tagged.select(F.col("cell_id").alias("src"), F.col("community").alias("_a"))
    b = tagged.select(F.col("cell_id").alias("dst"), F.col("community").alias("_b"))
    inner = cut_lineage(edges.where("src <> dst").join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst", "w"))
    own = tagged.join(units, "cell_id")
    mass = own.groupBy("community").agg(F.sum("k").alias("whole"))
    degree = inner.groupBy(F.col("src").alias("cell_id")).agg(F.sum("w").alias("e"))
    fixed = _looked_up(own, mass, "community").join(degree, "cell_id", "left").select("cell_id", "k", "whole", F.coalesce("e", F.lit(0.0)).alias("e"))
    fixed = cut_lineage(fixed)
    state = fixed.select("cell_id", F.col("cell_id").alias("part"))
    r = 0
    while True:
        placed = fixed.join(state, "cell_id")
        to = state.select(F.col("cell_id").alias("dst"), F.col("part").alias("to"))
        seen = inner.join(state.withColumnRenamed("cell_id", "src"), "src").join(to, "dst")
        within = seen.where("part = to").groupBy("part").agg(F.sum("w").alias("within"))
        sums = placed.groupBy("part").agg(F.count("*").alias("size"), F.sum("k").alias("mass"), F.sum("e").alias("out"), F.first("whole").alias("whole"))
        out = F.col("out") - F.coalesce("within", F.lit(0.0))
        good = out >= F.lit(resolution) * F.col("mass") * (F.col("whole") - F.col("mass")) / m2
        heads = uniform(seed, "refine", r, F.col("part")) < 0.5
        parts = sums.join(within, "part", "left").where(good).select("part", "size", "mass", heads.alias("heads"))
        one = parts.where("size = 1").select("part", F.col("mass").alias("k"), F.col("heads").alias("seeks"))
        other = parts.select(F.col("part").alias("to"), F.col("mass").alias("there"), F.col("heads").alias("_h"))
        tried = _looked_up(seen.where("part <> to").groupBy("part", "to").agg(F.sum("w").alias("w")).join(one, "part"), other, "to")
        tried = tried.withColumn("gain", F.col("w") - F.lit(resolution) * F.col("k") * F.col("there") / m2).where(F.col("gain") > least)
        best = lambda rows: rows.groupBy("part").agg(F.min_by("to", F.struct(F.negative(F.round(F.col("gain") / m2, 13)), F.col("to"))).alias("to"), F.max("gain").alias("gain"))
        tried = cut_lineage(tried.select("part", "to", "gain", (F.col("seeks") & ~F.col("_h")).alias("split")))
        total, split = tried.agg(F.count("*"), F.count(F.when(F.col("split"), 1))).first()
        if not total:  # every round leaves fewer parts, so rounds end
            return state
        joined = best(tried.where("split") if split else tried).withColumn("cell_id", F.col("part"))
        if not split:
            joined = _best_on_both_sides(joined, "part", "to")
        step = joined.select("part", F.col("to").alias("_to"))
        state = cut_lineage(state.join(step, "part", "left").select("cell_id", F.coalesce("_to", "part").alias("part")))
        r += 1

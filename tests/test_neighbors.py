import numpy as np
import pytest

from cytoweave.functions import vec as V
from cytoweave.operators import graph, neighbors


def brute(m, k, metric="l2sq", ids=None):
    if metric == "cosine":
        m = V.unit_rows(m)
        d = 1 - m @ m.T
    else:
        d = ((m[:, None, :] - m[None, :, :]) ** 2).sum(2)
    out = {}
    for i in range(len(m)):
        order = sorted((float(np.round(d[i, j], 9)), j) for j in range(len(m)) if j != i)
        out[i] = [j for _, j in order[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["src"], r["rank"])):
        out.setdefault(r["src"], []).append(r["dst"])
    return out


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("pivots,tile", [(1, 1024), (12, 16)])
def test_exact_join_equals_brute_force(vectors, metric, pivots, tile):
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(c, 0.05, (40, 5)) for c in (-2.0, 0.5, 3.0)])
    got = found(neighbors.knn_graph(vectors(m), 4, metric, pivots=pivots, rows_per_tile=tile))
    assert got == brute(m, 4, metric)


def test_pruning_skips_far_groups():
    import pyarrow as pa

    pivots = np.array([[0.0, 0.0], [50.0, 0.0]])
    stats = {0: (30, 0.1, 0.0), 1: (30, 0.1, 0.0)}
    rows = pa.array([[{"cell_id": 0, "vec": [0.05, 0.0]}], [{"cell_id": 1, "vec": [25.0, 0.0]}]])
    near_only = neighbors._router(pivots, stats, 4, None, False)
    assert near_only.func(rows).to_pylist() == [[0], [0, 1]]
    # more neighbours asked than the near group holds: the far one must be visited
    assert neighbors._router(pivots, stats, 31, None, False).func(rows).to_pylist() == [[0, 1], [0, 1]]


def test_duplicates_never_return_self(vectors):
    m = np.zeros((6, 3))
    got = found(neighbors.knn_graph(vectors(m), 2))
    assert all(i not in v and len(v) == 2 for i, v in got.items())
    assert got[0] == [1, 2] and got[5] == [0, 1]


def test_k_larger_than_table(vectors):
    got = found(neighbors.knn_graph(vectors(np.eye(3)), 10))
    assert {i: len(v) for i, v in got.items()} == {0: 2, 1: 2, 2: 2}


def test_zero_vector_under_cosine(vectors):
    m = np.array([[0.0, 0], [1, 0], [0, 1], [1, 1], [-1, 0.1]])
    got = found(neighbors.knn_graph(vectors(m), 3, "cosine", pivots=3, rows_per_tile=2))
    assert got == brute(m, 3, "cosine")


def test_hot_group_is_split(vectors):
    m = np.concatenate([np.full((300, 2), 1.0), np.random.default_rng(0).normal(0, 5, (30, 2))])
    got = found(neighbors.knn_graph(vectors(m), 3, pivots=4, rows_per_tile=32))
    assert got == brute(m, 3)


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_folding_copies_changes_nothing(vectors, metric):
    rng = np.random.default_rng(8)
    m = np.concatenate([np.tile([1.0, 2.0, 0.5], (40, 1)), np.tile([0.0, 0.0, 0.0], (5, 1)), rng.integers(0, 3, (40, 3)).astype(float)])
    df = vectors(m)
    a = found(neighbors.knn_graph(df, 4, metric, fold_copies=True, pivots=3, rows_per_tile=16))
    b = found(neighbors.knn_graph(df, 4, metric, fold_copies=False, pivots=3, rows_per_tile=16))
    assert a == b and len(a) == len(m)
    cross = neighbors.knn_join(df, df, 3, metric, fold_copies=True)
    assert found(cross) == found(neighbors.knn_join(df, df, 3, metric, fold_copies=False))


def test_approximate_recall(vectors):
    m = np.random.default_rng(3).normal(0, 1, (400, 4))
    df = vectors(m)
    near = neighbors.knn_graph(df, 5, nprobe=4, pivots=16, rows_per_tile=64)
    recall = neighbors.knn_recall(near, neighbors.knn_graph(df, 5)).first()[0]
    assert recall > 0.8


def test_restrict_graph_leaves_or_filters_sources(spark):
    knn = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 1)], "src bigint, dst bigint, rank int")
    nodes = spark.createDataFrame([(1,), (2,)], "cell_id bigint")
    assert neighbors.restrict_graph(knn, nodes).count() == 3
    assert neighbors.restrict_graph(knn, nodes, filter_src=True).count() == 2


def test_components_on_a_chain_and_an_island(spark):
    nodes = spark.range(0, 40).withColumnRenamed("id", "cell_id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(35, 36)], "src bigint, dst bigint")
    comp = {r[0]: r[1] for r in graph.connected_components(nodes, edges).collect()}
    assert all(comp[i] == 0 for i in range(30))
    assert comp[36] == 35 and comp[33] == 33


def test_communities_find_two_cliques(spark):
    pairs = [(i, j) for a in (0, 10) for i in range(a, a + 6) for j in range(a, a + 6) if i != j] + [(0, 10), (10, 0)]
    edges = spark.createDataFrame([(*p, 1.0) for p in pairs], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(i,) for a in (0, 10) for i in range(a, a + 6)], "cell_id bigint")
    members = graph.communities(nodes, edges)
    got = {r[0]: r[1] for r in members.collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]
    assert graph.modularity(edges, members).first()["modularity"] > 0.4


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_grid_equals_brute_force_where_nothing_is_pruned(vectors, metric, monkeypatch):
    monkeypatch.setattr(neighbors, "MOST_VISITS", 2)
    monkeypatch.setattr(neighbors, "QUERIES", 25)
    m = np.random.default_rng(11).normal(0, 1, (230, 24))
    m[:20] = m[20:40]
    m[50] = 0.0
    got = found(neighbors.knn_graph(vectors(m), 4, metric, pivots=8, rows_per_tile=16, fold_copies=False))
    assert got == brute(m, 4, metric)


def test_grid_of_probed_groups_equals_tiles(vectors, monkeypatch):
    m = np.random.default_rng(12).normal(0, 1, (230, 24))
    m[50] = 0.0
    df = vectors(m)
    probed = lambda: found(neighbors.knn_graph(df, 4, "cosine", nprobe=3, pivots=8, rows_per_tile=16))
    tiles = probed()
    monkeypatch.setattr(neighbors, "MOST_VISITS", 2)
    assert probed() == tiles


def test_a_row_of_a_large_table_is_copied_a_bounded_number_of_times(vectors, monkeypatch):
    """Each row used to be copied once per tile of the other side."""
    dealt = []
    real = neighbors._grid
    monkeypatch.setattr(neighbors, "MOST_VISITS", 4)
    monkeypatch.setattr(neighbors, "_grid", lambda q, b, qn, bn, *rest: dealt.append((qn, bn)) or real(q, b, qn, bn, *rest))
    m = np.random.default_rng(13).normal(0, 1, (1500, 16))
    neighbors.knn_graph(vectors(m), 3, pivots=30, rows_per_tile=50).count()
    assert dealt and all(sum(qn[1:] + bn[1:]) <= 2 * neighbors.SIDE for qn, bn in dealt)


def test_tiles_sent_to_many_others_are_never_broadcast(vectors):
    """Sizes are estimated before tiles are sent out: a broadcast took all copies to the driver."""
    from cytoweave.operators import tiles

    df = vectors(np.random.default_rng(14).normal(0, 1, (300, 4)))
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    packed = tiles.pack(df, [], 32)
    for joined in (neighbors.knn_graph(df, 3, pivots=4, rows_per_tile=64), tiles.pair_within(packed, packed, [], [])):
        assert "SortMergeJoin" in plan(joined) and "BroadcastHashJoin" not in plan(joined)


def test_community_modularity_searches_neighbours_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cytoweave.plans import graph_queries

    rows, search = spark.sparkContext.accumulator(0), graph_queries.knn

    def counted(*args, **kw):
        def run(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        found = search(*args, **kw)
        return found.mapInArrow(run, found.schema)

    monkeypatch.setattr(graph_queries, "knn", counted)
    monkeypatch.setattr(graph_queries.graph, "communities", lambda nodes, edges: nodes.select("cell_id", F.lit(edges.count() % 2).alias("community")))
    sf = "/root/testdata/sf0.001"
    assert graph_queries.community_modularity(spark, sf).count() == 1
    assert rows.value == graph_queries.K * spark.read.parquet(f"{sf}/embeddings.parquet").count()

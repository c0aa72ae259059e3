import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoweave.operators import assign, proto


@pytest.fixture
def protos(spark):
    return spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "proto_id int, vec array<double>")


def unbounded(monkeypatch):
    monkeypatch.setattr(proto, "bounded_matrix", lambda *a, **k: None)


def test_tie_goes_to_lowest_prototype_and_empty_ones_stay(vectors, protos):
    cells = vectors([[1.0, 1.0], [2.0, 0.1]], cell_type=["b", "a"])
    assigned = proto.nearest_prototype(cells, protos)
    assert {r["cell_id"]: r["proto_id"] for r in assigned.collect()} == {0: 0, 1: 0}
    purity = {r["proto_id"]: (r["n"], r["purity"]) for r in proto.prototype_purity(assigned, protos).collect()}
    assert purity == {0: (2, 0.5), 1: (0, None), 2: (0, None)}
    labels = {r["proto_id"]: (r["proto_label"], r["certainty"], r["n"]) for r in proto.label_by_assigned(assigned, protos).collect()}
    assert labels == {0: ("a", 0.5, 2), 1: ("none", 0.0, 0), 2: ("none", 0.0, 0)}
    s = proto.purity_summary(proto.prototype_purity(assigned, protos)).first()
    assert (s["min_purity"], s["min_count"], s["max_count"]) == (0.5, 0, 2) and abs(s["avg_count"] - 2 / 3) < 1e-12


def test_confidence_divides_by_k(vectors, protos):
    cells = vectors([[1.0, 0.0], [0.9, 0.1]], cell_type=["a", "a"])
    out = proto.label_by_top_cells(proto.pair_scores(cells, protos), cells, k=10).collect()
    assert all(abs(r["confidence"] - 0.2) < 1e-12 for r in out)


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_large_prototype_tables_give_the_same_answer(vectors, spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    cells = vectors(rng.normal(size=(60, 4)))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 4)))], "proto_id int, vec array<double>")
    small = {r["cell_id"]: (r["proto_id"], round(r["score"], 9)) for r in proto.nearest_prototype(cells, p, metric).collect()}
    unbounded(monkeypatch)
    large = {r["cell_id"]: (r["proto_id"], round(r["score"], 9)) for r in proto.nearest_prototype(cells, p, metric).collect()}
    assert small == large


def test_tiled_scores_equal_broadcast_scores(vectors, protos, monkeypatch):
    cells = vectors(np.random.default_rng(5).normal(size=(20, 2)))
    key = lambda df: sorted((r["cell_id"], r["proto_id"], round(r["s"], 9)) for r in df.collect())
    a, m = key(proto.pair_scores(cells, protos)), key(proto._column_minima(cells, protos, "l2").select(F.lit(0).alias("cell_id"), "proto_id", F.col("d").alias("s")))
    unbounded(monkeypatch)
    assert a == key(proto.pair_scores(cells, protos))
    assert m == key(proto._column_minima(cells, protos, "l2").select(F.lit(0).alias("cell_id"), "proto_id", F.col("d").alias("s")))


def numpy_sinkhorn(s, eps, rounds):
    q = np.exp((s - s.max()) / eps)
    for _ in range(rounds):
        q = q / q.sum(0, keepdims=True)
        q = q / q.sum(1, keepdims=True)
    return q


def test_sinkhorn_matches_numpy_inside_groups(spark):
    rng = np.random.default_rng(6)
    s = rng.normal(size=(30, 4)) * 0.2
    df = spark.createDataFrame([(i, "ab"[i % 2], r.tolist()) for i, r in enumerate(s)], "cell_id bigint, g string, s array<double>")
    got = {r["cell_id"]: r["q"] for r in assign.sinkhorn(df, 0.05, 3, by=["g"]).collect()}
    for g in (0, 1):
        rows = list(range(g, 30, 2))
        want = numpy_sinkhorn(s[rows], 0.05, 3)
        assert np.allclose([got[i] for i in rows], want, atol=1e-9)
    many = np.array([r["q"] for r in assign.sinkhorn(df, 0.2, 8).collect()])
    assert np.allclose(many.sum(1), 1) and np.allclose(many.sum(0), 30 / 4, rtol=2e-2)


def log_sinkhorn(s, eps, rounds):
    lse = lambda m, axis: m.max(axis, keepdims=True) + np.log(np.exp(m - m.max(axis, keepdims=True)).sum(axis, keepdims=True))
    q = np.array(s) / eps
    for _ in range(rounds):
        q = q - lse(q, 0)
        q = q - lse(q, 1)
    return np.exp(q)


def test_sinkhorn_on_any_range_of_scores(spark):
    rng = np.random.default_rng(9)
    wide = rng.normal(size=(60, 3)) * 400.0
    for rows, rounds in (([[100.0, 0.0], [0.0, 1.0]], 3), ([[100.0, 0.0], [0.0, 1.0]], 9), ([[0.0, -5000.0]] * 3, 3), (wide.tolist(), 5)):
        df = spark.createDataFrame(list(enumerate(rows)), "cell_id bigint, s array<double>").repartition(3)
        got = {r["cell_id"]: r["q"] for r in assign.sinkhorn(df, 0.05, rounds).collect()}
        assert np.allclose([got[i] for i in range(len(rows))], log_sinkhorn(rows, 0.05, rounds), atol=1e-9)
    # in the limit each of two cells has its own prototype, whatever the gap
    assert np.allclose(log_sinkhorn([[100.0, 0.0], [0.0, 1.0]], 0.05, 9), np.eye(2))


def test_sinkhorn_null_groups_and_impossible_prototypes(spark):
    rows = [(0, None, [1.0, 2.0]), (1, None, [2.0, 1.0]), (2, "a", [0.5, float("-inf")]), (3, "a", [0.1, float("-inf")])]
    df = spark.createDataFrame(rows, "cell_id bigint, g string, s array<double>")
    got = {r["cell_id"]: r["q"] for r in assign.sinkhorn(df, 0.5, 3, by=["g"]).collect()}
    assert np.allclose([got[0], got[1]], log_sinkhorn([[1.0, 2.0], [2.0, 1.0]], 0.5, 3))
    assert got[2] == got[3] == [1.0, 0.0]
    assert assign.sinkhorn(df.limit(0), 0.5, 3, by=["g"]).count() == assign.sinkhorn(df.limit(0)).count() == 0


def test_hard_assignment_takes_first_maximum(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0])], "cell_id bigint, s array<double>")
    assert assign.hard_assignment(df).first()["q"] == [0.0, 1.0, 0.0]


def test_spherical_kmeans_keeps_empty_centroids(vectors):
    m = np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 5)
    centres, assigned = assign.spherical_kmeans(vectors(m), 4, rounds=3)
    assert centres.count() == 4
    assert assigned.select("proto_id").distinct().count() <= 2
    norms = [np.linalg.norm(r["vec"]) for r in centres.collect()]
    assert np.allclose(norms, 1)


def test_redundancy_of_identical_views_is_only_off_diagonal(vectors):
    m = np.random.default_rng(7).normal(size=(200, 3))
    df = vectors(m).select(F.col("vec").alias("a"), F.col("vec").alias("b"))
    got = assign.redundancy_score(df, lam=0.01, eps=0.0).first()[0]
    c = np.corrcoef(m.T)
    assert abs(got - 0.01 * ((c**2).sum() - 3)) < 1e-9


def test_geometry(protos):
    near = proto.nearest_prototype_distance(protos).first()
    assert abs(near["min_d"] - 2**0.5) < 1e-9 and abs(near["max_d"] - 2**0.5) < 1e-9
    assert abs(proto.mean_pairwise_distance(protos).first()[0] - (2 * 2**0.5 + 2) / 3) < 1e-9
    assert abs(proto.repulsion(protos).first()[0] - (2 / (2**0.5 + 1e-5) + 1 / (2 + 1e-5))) < 1e-9


def test_bank_keeps_latest(spark):
    rows = [(0, 1, [1.0], 1), (0, 1, [2.0], 5), (1, 1, [3.0], 2)]
    bank = spark.createDataFrame(rows, "bank_no int, cell_id bigint, vec array<double>, step bigint")
    late = spark.createDataFrame([(1, 1, [9.0], 7)], bank.schema)
    got = {(r["bank_no"], r["cell_id"]): r["vec"] for r in assign.bank_update(bank, late).collect()}
    assert got == {(0, 1): [2.0], (1, 1): [9.0]}


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("bounded", [True, False])
def test_top_cells_without_pair_rows(vectors, monkeypatch, metric, bounded):
    """Ties by cell id, blocks of few rows, more wanted than there are; no row per cell and prototype in the plan."""
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(90, 2)), 1)
    x[40:60] = x[:20]
    p = np.round(rng.normal(size=(5, 2)), 1)
    monkeypatch.setattr(proto, "BLOCK", 35)
    if not bounded:
        monkeypatch.setattr(proto, "bounded_matrix", lambda *a, **k: None)
    cells, protos = vectors(x).repartition(3), vectors(p).withColumnRenamed("cell_id", "proto_id")
    s = x @ p.T if metric == "dot" else np.sqrt(((x[:, None] - p[None]) ** 2).sum(-1))
    for k in (1, 7, 200):
        found = proto.top_cells(cells, protos, k, metric)
        got = {(r["proto_id"], r["rank"]): (r["cell_id"], round(r["s"], 9)) for r in found.collect()}
        assert len(got) == 5 * min(k, 90)
        for j in range(5):
            order = sorted(range(90), key=lambda i: (-round(s[i, j], 9) if metric == "dot" else round(s[i, j], 9), i))[:k]
            assert [got[j, r] [1] for r in range(1, len(order) + 1)] == [round(s[i, j], 9) for i in order]
    assert "Generate" not in proto.top_cells(cells, protos, 3, metric)._jdf.queryExecution().executedPlan().toString() or not bounded

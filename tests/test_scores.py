import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoweave.operators import evaluate, integration, neighbors, rank, relate, select, stats


def preds(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "cell_id bigint, y_true string, y_pred string")


def test_f1_with_never_predicted_and_only_predicted_classes(spark):
    per = evaluate.f1_per_class(preds(spark, [("a", "a"), ("a", "c"), ("b", "a"), ("b", "c")]))
    got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in per.collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 2), "c": (0.0, 0.0, 0.0, 0)}
    s = evaluate.f1_summary(per).first()
    assert (s["f1_micro"], round(s["f1_macro"], 9), s["f1_weighted"]) == (0.25, round(0.5 / 3, 9), 0.25)


def test_knn_vote_tie_takes_smallest_label(vectors):
    train = vectors([[0.0], [1.0], [10.0]], cell_type=["z", "b", "q"])
    test = vectors([[0.5]], cell_type=["b"])
    assert evaluate.knn_classify(train, test, k=2).first()["y_pred"] == "b"


def test_top_k_accuracy_breaks_ties_by_position(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5, 0.1])], "label int, s array<double>")
    r = evaluate.top_k_accuracy(df, "label", ks=(1, 2)).first()
    assert (r["top1"], r["top2"]) == (0.0, 1.0)


def test_density_forms_agree_and_match_formula(vectors, spark):
    xy = np.random.default_rng(2).normal(size=(300, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cell_id bigint, x double, y double")
    exact = np.array([r["density"] for r in evaluate.point_density(pts).orderBy("cell_id").collect()])
    cov = np.cov(xy.T) * 300 ** (-1 / 3)
    diff = xy[:, None, :] - xy[None, :, :]
    want = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", diff, np.linalg.inv(cov), diff)).sum(1) / (300 * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    assert np.allclose(exact, want)
    mesh = np.array([r["density"] for r in evaluate.mesh_density(pts).orderBy("cell_id").collect()])
    assert np.allclose(mesh, want, rtol=1e-2)


def test_silhouette_of_a_single_cell_label_is_zero(vectors):
    cells = vectors([[0.0], [1.0], [10.0]], cell_type=["a", "a", "b"])
    got = {r["cell_id"]: r["s"] for r in integration.silhouette(cells, "cell_type").collect()}
    assert got[2] == 0.0 and abs(got[0] - 0.9) < 1e-6


def test_silhouette_over_many_tiles(vectors, monkeypatch):
    from cytoweave.operators import tiles

    m = np.random.default_rng(3).normal(size=(90, 3))
    lab = ["hot"] * 70 + ["b"] * 20
    cells = vectors(m, cell_type=lab)
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    own = np.array(lab)
    want = []
    for i in range(90):
        a = d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = d[i, own != own[i]].mean()
        want.append((b - a) / max(a, b))
    monkeypatch.setattr(integration, "pack", lambda df, keys: tiles.pack(df, keys, rows_per_tile=8))
    got = [r["s"] for r in integration.silhouette(cells, "cell_type").orderBy("cell_id").collect()]
    assert np.allclose(got, want, atol=1e-7)


def shuffled_bytes(spark):
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none[1], none[0])
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_silhouette_copies_no_tile_for_every_other(vectors, monkeypatch, spark):
    from cytoweave.operators import tiles

    m = np.random.default_rng(6).normal(size=(1600, 16))
    lab = [str(i % 3) for i in range(1600)]
    monkeypatch.setattr(integration, "pack", lambda df, keys: tiles.pack(df, keys, rows_per_tile=8))
    before = shuffled_bytes(spark)
    got = [r["s"] for r in integration.silhouette(vectors(m, cell_type=lab), "cell_type").orderBy("cell_id").collect()]
    # 200 tiles; each in all meetings of eight blocks would be 2 MB
    assert shuffled_bytes(spark) - before < 4e6
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    means = np.stack([d[:, g::3].sum(1) for g in range(3)], axis=1) / np.array([534, 533, 533])
    own = np.arange(1600) % 3
    a = means[np.arange(1600), own] * np.array([534, 533, 533])[own] / np.array([533, 532, 532])[own]
    means[np.arange(1600), own] = np.inf
    assert np.allclose(got, (means.min(1) - a) / np.maximum(a, means.min(1)), atol=1e-9)


@pytest.mark.parametrize("held", [1 << 16, 20])
def test_silhouette_in_blocks_and_with_sums_given_early(vectors, monkeypatch, held):
    from cytoweave.operators import tiles

    m = np.repeat(np.random.default_rng(7).normal(size=(45, 3)), 2, axis=0)
    lab = [str(i % 4) for i in range(90)]
    cells = vectors(m, cell_type=lab)
    want = [r["s"] for r in integration.silhouette(cells, "cell_type").orderBy("cell_id").collect()]
    monkeypatch.setattr(integration, "pack", lambda df, keys: tiles.pack(df, keys, rows_per_tile=4))
    monkeypatch.setattr(integration, "HELD", held)
    monkeypatch.setattr(integration, "SUMS", 8)
    got = [r["s"] for r in integration.silhouette(cells, "cell_type").orderBy("cell_id").collect()]
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    own = np.arange(90) % 4
    a = np.array([d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1) for i in range(90)])
    b = np.array([min(d[i, own == g].mean() for g in range(4) if g != own[i]) for i in range(90)])
    assert np.allclose(got, want, atol=1e-12) and np.allclose(got, (b - a) / np.maximum(a, b), atol=1e-9)


def test_diversity_equals_slow_bisection(vectors, spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 3))
    lab = [str(v) for v in rng.integers(0, 3, 60)]
    cells = vectors(m, batch=lab)
    knn = neighbors.knn_graph(cells, 15, "l2")
    got = {r["cell_id"]: r["diversity"] for r in integration.neighbour_diversity(knn, cells, "batch", 5.0).collect()}
    edges = {}
    for r in knn.collect():
        edges.setdefault(r["src"], []).append((r["dist"], lab[r["dst"]]))
    for i in (0, 17, 59):
        d = np.array([e[0] for e in edges[i]])
        lo, hi = 0.0, 1e6
        for _ in range(200):
            beta = (lo + hi) / 2
            p = np.exp(-(d - d.min()) * beta)
            h = np.log(p.sum()) + beta * (p * (d - d.min())).sum() / p.sum()
            lo, hi = (beta, hi) if h > np.log(5.0) else (lo, beta)
        p = p / p.sum()
        share = {}
        for w, (_, l) in zip(p, edges[i]):
            share[l] = share.get(l, 0) + w
        assert abs(got[i] - 1 / sum(v * v for v in share.values())) < 1e-4


@pytest.mark.parametrize("values", [[3.0, 1.0, 2.0], [4.0, 1.0, 2.0, 3.0], [7.0] * 9])
def test_exact_median(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "cell_id bigint, v double")
    assert integration.exact_median(df, "v").first()[0] == float(np.median(values))


def test_nmi_ari_of_equal_partitions(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    r = integration.nmi_ari(df, "a", "b").first()
    assert abs(r["nmi"] - 1) < 1e-12 and abs(r["ari"] - 1) < 1e-12


def test_majority_first_seen_wins(spark):
    df = spark.createDataFrame([(1, ["b", "a", "a", "b"])], "anchor_id bigint, v array<string>")
    assert rank.majority_of_array(df, "v", "m").first()["m"] == "b"


def test_leaderboard_flags(spark):
    df = spark.createDataFrame([("base1", 0.5, 0.1), ("base2", 0.4, 0.9), ("new", 0.6, 0.05)], "model string, total double, knn double")
    rows = rank.leaderboard(df, "total", ["total", "knn"], F.col("model").startswith("base")).collect()
    assert [r["model"] for r in rows] == ["new", "base1", "base2"]
    assert (rows[0]["total_above"], rows[0]["knn_above"], rows[2]["knn_above"]) == (True, False, True)


def test_leaderboard_reads_its_rows_once(spark):
    # values differ with every evaluation, as sums do in their last digits
    drawn = F.udf(lambda _: random.random(), "double").asNondeterministic()
    df = spark.range(20).select(F.concat(F.lit("base"), "id").alias("model"), drawn("id").alias("total"), drawn("id").alias("knn"))
    best, *rest = rank.leaderboard(df, "total", ["total", "knn"], F.col("model").startswith("base")).collect()
    assert not best["total_above"] and not best["knn_above"]
    assert [r["knn_above"] for r in rest] == [r["knn"] > best["knn"] for r in rest]


def test_singletons_missing_and_numbers(spark):
    df = spark.createDataFrame([("a", "1.5", None), ("a", "x", float("nan")), ("b", None, 2.0)], "cell_type string, t string, v double")
    assert select.drop_singletons(df).count() == 2
    assert sorted(r["v"] for r in select.missing_to_zero(df, ["v"]).collect()) == [0.0, 0.0, 2.0]
    assert select.coerce_numeric(df.select("t"), ["t"]).count() == 1


def test_dense_mean_counts_zeros(spark):
    counts = spark.createDataFrame([(0, 0, 4.0)], "cell_id bigint, gene_id bigint, x double")
    cells = spark.range(4).withColumnRenamed("id", "cell_id")
    genes = spark.range(2).withColumnRenamed("id", "gene_id")
    assert {r[0]: r[1] for r in stats.gene_means(counts, cells, genes).collect()} == {0: 1.0, 1: 0.0}


def test_outer_by_class_keeps_both_sides(spark):
    a = spark.createDataFrame([("x", 0.5)], "class string, f1 double")
    b = spark.createDataFrame([("y", 0.7)], "class string, f1 double")
    got = {r["class"]: (r["m1"], r["m2"]) for r in relate.outer_by_class({"m1": a, "m2": b}).collect()}
    assert got == {"x": (0.5, None), "y": (None, 0.7)}

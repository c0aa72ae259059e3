import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoweave.functions import special
from cytoweave.operators import differential, prep


@pytest.fixture
def small(spark):
    """5 cells x 4 genes; cell 4 has no counts, gene 3 is constant over stored cells."""
    dense = np.array([[5.0, 0, 1, 2], [0, 3, 1, 2], [2, 2, 0, 2], [150, 0, 0, 2], [0, 0, 0, 2]])
    rows = [(i, j, float(dense[i, j])) for i in range(5) for j in range(4) if dense[i, j] and i < 4]
    dense[4] = 0
    counts = spark.createDataFrame(rows, "cell_id bigint, gene_id bigint, x double")
    cells = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(5)], "cell_id bigint, cell_type string")
    genes = spark.createDataFrame([(j, f"g{j}", j == 0) for j in range(4)], "gene_id bigint, gene_name string, mt boolean")
    return dense, counts, cells, genes


def test_dense_scale_equals_numpy(small):
    dense, counts, cells, genes = small
    got = {(r["cell_id"], r["gene_id"]): r["x"] for r in prep.scale_dense(counts, cells, 1.5).collect()}
    sd = dense.std(0, ddof=1)
    want = np.minimum((dense - dense.mean(0)) / np.where(sd > 0, sd, 1), 1.5)
    assert len(got) == 20 and np.allclose([got[(i, j)] for i in range(5) for j in range(4)], want.reshape(-1))


def test_zero_variance_gene_scales_to_zero(spark):
    counts = spark.createDataFrame([(i, 0, 2.0) for i in range(3)], "cell_id bigint, gene_id bigint, x double")
    cells = spark.range(3).withColumnRenamed("id", "cell_id")
    assert {r["x"] for r in prep.scale_dense(counts, cells).collect()} == {0.0}


def test_regression_residuals_equal_least_squares(small, spark):
    dense, counts, cells, _ = small
    z = np.array([[1.0, 2], [2, 1], [4, 4], [3, 9], [0, 1]])
    cov = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "cell_id bigint, a double, b double")
    got = {(r["cell_id"], r["gene_id"]): r["x"] for r in prep.regress_out(counts, cov, "a", "b").collect()}
    x = np.column_stack([np.ones(5), z])
    want = dense - x @ np.linalg.lstsq(x, dense, rcond=None)[0]
    assert np.allclose([got[(i, j)] for i in range(5) for j in range(4)], want.reshape(-1))


def test_collinear_covariates_fall_back_to_one(small, spark):
    _, counts, cells, _ = small
    cov = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(5)], "cell_id bigint, a double, b double")
    assert prep.regression_coefficients(counts, cov, "a", "b").where("b2 <> 0").count() == 0


def test_pca_reconstructs_variance(vectors):
    m = np.random.default_rng(0).normal(size=(100, 4)) * np.array([5, 2, 1, 0.1])
    scores, share = prep.pca(vectors(m), 4)
    s = np.array([r["vec"] for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(s.mean(0), 0, atol=1e-9)
    assert np.allclose(np.sort(s.var(0, ddof=1)), np.sort(np.linalg.eigvalsh(np.cov(m.T))))
    assert abs(sum(share) - 1) < 1e-9


def test_missing_values_are_filled_and_logged(small, spark):
    _, counts, cells, genes = small
    holed = counts.unionAll(spark.createDataFrame([(4, 0, float("nan")), (4, 1, None)], counts.schema))
    out = prep.preprocess(holed, cells, genes, "standard", min_genes=1, min_cells=1)
    assert "missing: filled with 0" in [r["action"] for r in out.log.collect()]
    assert out.cells.count() == 5 or out.cells.count() == 4


def test_reference_order_never_logs_data_with_zeros(small):
    _, counts, cells, genes = small
    out = prep.preprocess(counts, cells, genes, "reference", min_genes=1, min_cells=1)
    log = [r["action"] for r in out.log.orderBy("step").collect()]
    assert log == ["missing: none", "normalize: to 10000", "log1p: skipped, zero or negative values", "variable genes: found", "scale: applied", "filter: last"]


def test_filter_after_scaling_counts_absent_entries(spark):
    """A gene with a negative mean gives absent entries a positive scaled value."""
    counts = spark.createDataFrame([(0, 0, -9.0), (1, 1, 4.0)], "cell_id bigint, gene_id bigint, x double")
    cells = spark.range(3).select(F.col("id").alias("cell_id"), F.lit("a").alias("cell_type"))
    genes = spark.createDataFrame([(0, "g0"), (1, "g1")], "gene_id bigint, gene_name string")
    out = prep.preprocess(counts, cells, genes, "reference", min_genes=1, min_cells=1)
    assert sorted(r["cell_id"] for r in out.cells.collect()) == [1, 2]


def test_rank_sum_equals_brute_force_with_ties_and_negatives(spark):
    rng = np.random.default_rng(1)
    dense = rng.integers(-2, 4, size=(30, 3)).astype(float)
    lab = ["a"] * 12 + ["b"] * 13 + ["c"] * 5
    counts = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(30) for j in range(3) if dense[i, j]], "cell_id bigint, gene_id bigint, x double")
    cells = spark.createDataFrame(list(enumerate(lab)), "cell_id bigint, cell_type string")
    genes = spark.range(4).withColumnRenamed("id", "gene_id")
    got = {r["gene_id"]: r["rank_sum"] for r in differential.rank_sum(counts, cells, genes, "a", "b").collect()}
    for j in range(3):
        x = dense[:25, j]
        ranks = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
        assert abs(got[j] - ranks[:12].sum()) < 1e-9
    assert got[3] == 12 * 13.0


def test_rank_sum_of_groups_whose_product_is_beyond_64_bits(spark):
    million = spark.range(5_200_000)
    cells = million.select(F.col("id").alias("cell_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("cell_type"))
    counts = spark.createDataFrame([(0, 1, 3.0), (2, 1, 5.0)], "cell_id bigint, gene_id bigint, x double")
    genes = spark.createDataFrame([(1,)], "gene_id bigint")
    got = differential.rank_sum(counts, cells, genes, "a", "b").first()
    n, m = 2_600_000, 5_200_000
    total = (n - 2) * (m - 2 + 1) / 2 + (m - 1) + m
    assert got["rank_sum"] == total
    assert got["score"] == pytest.approx((total - n * (m + 1) / 2) / (n * n * (m + 1) / 12) ** 0.5, rel=1e-9)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0, "g", 0.01), (1, "g", 0.04), (2, "g", 0.03), (3, "g", 0.5)], "gene_id bigint, grp string, p double")
    got = {r["gene_id"]: round(r["p_adj"], 9) for r in differential.adjust_p(df, ["grp"]).collect()}
    assert got == {0: 0.04, 1: round(0.04 * 4 / 3, 9), 2: round(0.04 * 4 / 3, 9), 3: 0.5}


def test_tails():
    assert np.allclose(special.chi2_tail(np.array([3.841, 5.991, 7.815, 9.488, 11.07]), np.arange(1.0, 6.0)), 0.05, atol=1e-4)
    assert np.allclose(special.t_two_sided(np.array([2.776, 2.086, -2.086]), np.array([4.0, 20.0, 20.0])), 0.05, atol=1e-4)
    assert np.allclose(special.normal_two_sided(np.array([1.959964])), 0.05, atol=1e-6)


def test_welch_equals_formula(small):
    dense, counts, cells, genes = small
    got = {(r["cell_type"], r["gene_id"]): r["score"] for r in differential.welch_markers(counts, cells, genes).collect()}
    a, b = dense[[0, 2, 4]], dense[[1, 3]]
    for j in range(4):
        se = np.sqrt(a[:, j].var(ddof=1) / 3 + b[:, j].var(ddof=1) / 2)
        assert abs(got[("a", j)] - ((a[:, j].mean() - b[:, j].mean()) / se if se else 0)) < 1e-9


def test_known_markers_keep_genes_that_exist(spark, small):
    from cytoweave.functions.markers import known_markers, marker_table

    _, _, _, genes = small
    got = known_markers(spark, genes, {"t": ["g1", "absent"], "u": ["g1", "g3"]}).collect()
    assert sorted((r["cell_type"], r["gene_id"]) for r in got) == [("t", 1), ("u", 1), ("u", 3)]
    assert marker_table(spark).count() == 64


def test_local_quadratic_follows_quadratics_and_survives_ties():
    x = np.sort(np.random.default_rng(1).normal(size=80))
    assert np.allclose(prep.local_quadratic(x, 2 - x + 3 * x * x, x, 0.3), 2 - x + 3 * x * x)
    bent = np.where(x > 0, x, 0.0)
    near = prep.local_quadratic(x, bent, x, 0.2)
    one = np.polyval(np.polyfit(x, bent, 2), x)
    assert np.abs(near - bent).mean() < np.abs(one - bent).mean() / 3
    tied = np.array([0.0, 0.0, 0.0, 1.0, 1.0])
    assert np.allclose(prep.local_quadratic(tied, np.array([1.0, 2.0, 3.0, 5.0, 7.0]), tied, 0.4), [2, 2, 2, 6, 6])
    assert np.allclose(prep.local_quadratic(tied, np.array([1.0, 2.0, 3.0, 5.0, 7.0]), np.array([0.0]), 0.8), [2.0])


def test_local_stabilised_variance_of_genes_that_never_vary(spark):
    counts = spark.createDataFrame([(i, 0, 2.0) for i in range(4)] + [(0, 1, 5.0), (1, 1, 1.0), (2, 2, 3.0)], "cell_id bigint, gene_id bigint, x double")
    found = {r["gene_id"]: r["var_norm"] for r in prep.stabilised_variance(counts, spark.range(4).withColumnRenamed("id", "cell_id")).collect()}
    assert found[0] == 0.0 and found[1] > 0 and found[2] > 0


def test_equal_genes_are_fitted_once_and_count_as_often():
    rng = np.random.default_rng(4)
    x, times = np.sort(rng.normal(size=60)), rng.integers(1, 9, 60)
    y = x * x + rng.normal(size=60)
    folded = prep.local_quadratic(x, y, x, 0.3, times)
    assert np.allclose(folded, prep.local_quadratic(np.repeat(x, times), np.repeat(y, times), x, 0.3))

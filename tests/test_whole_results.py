"""No row is lost, no answer depends on sizes: cases for operators that once did."""

import datetime
import os

import numpy as np
import pytest

from cytoweave.functions import ranks, special
from cytoweave.functions.bounds import bounded_matrix
from cytoweave.operators import evaluate, graph, integration, neighbors, prep
from cytoweave.session import scratch_path
from cytoweave.sources import results
from cytoweave.streaming import streams


@pytest.fixture
def counts(spark):
    return spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (1, 2, 4.0), (2, 9, 5.0)], "cell_id bigint, gene_id bigint, x double")


@pytest.fixture
def four_cells(spark):
    return spark.range(4).withColumnRenamed("id", "cell_id")


def test_dense_vectors_have_a_row_for_every_cell(counts, four_cells):
    got = {r[0]: list(r[1]) for r in prep.dense_vectors(counts, "gene_id", [1, 2], four_cells).collect()}
    assert got == {0: [2.0, 1.0], 1: [0.0, 4.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_dense_rows_do_not_depend_on_gene_blocks(counts, four_cells):
    per_gene = counts.groupBy("gene_id").avg("x").withColumnRenamed("avg(x)", "m")
    one, many = (sorted(map(tuple, prep.dense_rows(counts, four_cells, per_gene, "gene_id", ["m"], block=b).collect())) for b in (100, 1))
    assert one == many and len(one) == 4 * 3


def test_acceptance_counts_every_cell(spark):
    cells = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "a", "x"), (3, "b", "x"), (4, "c", "y"), (5, "c", "y")], "cell_id bigint, cell_type string, batch string")
    knn = spark.createDataFrame([(0, 1), (0, 3), (1, 0), (3, 0), (4, 5)], "src bigint, dst bigint")
    got = {r["cell_type"]: (r["n_cells"], r["acceptance"]) for r in integration.batch_acceptance(knn, cells).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 3, "b": 1, "c": 2}
    assert got["b"][1] == got["c"][1] == 1.0


def test_one_batch_and_one_label_have_values(spark, vectors):
    m = np.random.default_rng(0).normal(size=(12, 3))
    cells = vectors(m, cell_type=["a"] * 12, batch=["x"] * 12)
    knn = neighbors.knn_graph(cells, 4, "l2")
    assert tuple(integration.mixing_scores(knn, cells).first()) == (1.0, 1.0)
    assert integration.batch_variance_drop(cells, cells).first()[0] == 0.0


def test_probing_does_not_depend_on_tiles(vectors):
    m = np.random.default_rng(1).normal(size=(300, 4))
    cells = vectors(m)
    found = [sorted(map(tuple, neighbors.knn_graph(cells, 5, nprobe=2, pivots=12, rows_per_tile=n).select("src", "dst").collect())) for n in (8, 256)]
    assert found[0] == found[1]


def test_a_group_with_most_rows_is_many_addresses(vectors):
    m = np.concatenate([np.random.default_rng(2).normal(0, 0.01, (180, 3)), np.random.default_rng(3).normal(9, 1, (20, 3))])
    got = {(r["src"], r["dst"]) for r in neighbors.knn_graph(vectors(m), 3, pivots=4, rows_per_tile=16).collect()}
    d = ((m[:, None] - m[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(len(m)) for j in np.argsort(d[i], kind="stable")[:3]}


def test_median_of_a_column_of_mostly_one_value(spark):
    values = [1.0] * 980 + [float(i) for i in range(2, 22)]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    assert integration.exact_median(df, "d").first()[0] == np.median(values)
    assert integration.exact_median(spark.createDataFrame([(1.0,), (4.0,)], "d double"), "d").first()[0] == 2.5


def test_quantile_buckets_are_even_on_a_heavy_tail(spark):
    df = spark.range(4000).selectExpr("exp(id / 200.0) as v")
    sizes = [r["count"] for r in ranks.quantile_buckets(df, "v", "b", rows_per_bucket=400).groupBy("b").count().collect()]
    assert len(sizes) == 11 and max(sizes) < 600


def test_late_days_are_kept(spark):
    folder, out, mark = (scratch_path(spark, n) for n in ("late", "epochs", "mark"))
    day = datetime.datetime(2024, 3, 10)
    for i, shift in enumerate((0, 5, 12, 1)):
        row = [(day + datetime.timedelta(days=shift), 2.0, 1)]
        spark.createDataFrame(row, "ts timestamp, value double, n int").coalesce(1).write.parquet(os.path.join(folder, f"f{i}"))
    stream = spark.readStream.schema("ts timestamp, value double, n int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    streams.keep_updates(streams.epoch_averages(stream, "ts", "value", "n"), out, mark).awaitTermination()
    assert streams.latest_updates(spark, out, "epoch").count() == 4


def test_chi_square_tail_far_out():
    x, df = np.array([1600.0, 0.0, 3.84, 10.0]), np.array([1600.0, 3.0, 1.0, 4.0])
    assert np.allclose(special.chi2_tail(x, df), [0.4953, 1.0, 0.05004, 0.04043], atol=1e-4)


def test_sizes_are_counted_before_rows_are_sent(spark):
    df = spark.createDataFrame([(i, [0.0] * 3) for i in range(5)], "id int, vec array<double>")
    assert bounded_matrix(df, "id", "vec", max_rows=4) is None
    assert bounded_matrix(df, "id", "vec", max_rows=5)[1].shape == (5, 3)


def test_graph_path_tells_metrics_apart():
    paths = {results.graph_path("r", "d", 9, None, None, 5, metric=m, nprobe=p) for m in ("l2", "cosine") for p in (None, 3)}
    assert len(paths) == 4


def test_communities_are_connected_and_settle(spark):
    edges = [(a, b) for block in (range(0, 6), range(6, 12)) for a in block for b in block if a != b] + [(0, 6), (6, 0)]
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src bigint, dst bigint, w double")
    members = {r["cell_id"]: r["community"] for r in graph.communities(spark.range(12).withColumnRenamed("id", "cell_id"), frame).collect()}
    assert len({members[i] for i in range(6)}) == 1 and len(set(members.values())) == 2


def _pieces(members, edges):
    """Communities and the number of pieces that each is in, by a plain search."""
    near = {}
    for a, b in edges:
        if members[a] == members[b]:
            near.setdefault(a, set()).add(b)
    pieces, seen = {}, set()
    for node in members:
        if node not in seen:
            pieces[members[node]] = pieces.get(members[node], 0) + 1
            todo = [node]
            while todo:
                at = todo.pop()
                if at not in seen:
                    seen.add(at)
                    todo += near.get(at, ())
    return pieces


def test_communities_of_planted_groups(spark):
    """Five groups with bridges, a hub that holds two of them together, a lone node: connected, and no worse than label moves."""
    rng = np.random.default_rng(11)
    pairs = {(a, b) for g in range(5) for a in range(12 * g, 12 * g + 12) for b in range(12 * g, a) if rng.random() < 0.5}
    pairs |= {(max(a, b), min(a, b)) for a, b in rng.integers(0, 60, (12, 2)).tolist() if a != b}
    pairs |= {(60, b) for b in range(0, 24, 2)}
    edges = sorted(pairs | {(b, a) for a, b in pairs})
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src bigint, dst bigint, w double")
    nodes = spark.range(62).withColumnRenamed("id", "cell_id")
    found = graph.communities(nodes, frame).cache()
    members = {r["cell_id"]: r["community"] for r in found.collect()}
    assert len(members) == 62 and set(_pieces(members, edges).values()) == {1} and members[61] == 61
    assert all(members[c] == c for c in members.values())
    assert len({members[a] for g in (2, 3, 4) for a in range(12 * g, 12 * g + 12)}) == 3
    labels = graph.communities(nodes, frame, refine=False)
    assert graph.modularity(frame, found).first()["modularity"] >= graph.modularity(frame, labels).first()["modularity"] - 1e-9


def test_connected_parts_cut_what_is_not_connected(spark):
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in [(1, 2), (2, 1), (3, 4), (4, 3), (2, 5), (5, 2)]], "src bigint, dst bigint, w double")
    members = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (4, 9), (5, 8)], "cell_id bigint, community bigint")
    assert {tuple(r) for r in graph.connected_parts(members, frame).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 500: 500}


def test_classifier_is_fitted_on_reference_cells_only(vectors):
    rng = np.random.default_rng(4)
    ref = vectors(np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(3, 0.1, (20, 2))]), cell_type=["a"] * 20 + ["b"] * 20)
    query = vectors(np.array([[0.0, 0.1], [3.1, 3.0], [2.9, 3.0]]), cell_type=["a", "b", "c"])
    got = {r["cell_id"]: (r["y_true"], r["y_pred"]) for r in evaluate.reference_evaluation(ref, query).collect()}
    assert got == {0: ("a", "a"), 1: ("b", "b"), 2: ("c", "b")}

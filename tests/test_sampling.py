import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cytoweave.functions.rand import uniform
from cytoweave.functions.ranks import running_sum, uniform_rank, width_bucket
from cytoweave.operators import splits, views


@pytest.fixture
def cells(spark):
    """One hot label (a third of the rows and more), one small label, one single cell."""
    return spark.range(0, 300).select(
        F.col("id").alias("cell_id"),
        F.when(F.col("id") < 200, "hot").when(F.col("id") < 299, "mid").otherwise("single").alias("cell_type"),
        F.when(F.col("id") % 3 == 0, "s0").otherwise("s1").alias("study"),
    )


def test_uniform_is_the_first_32_bits_of_md5(spark):
    import hashlib

    got = spark.range(3).select(uniform(7, "op", F.col("id")).alias("u")).collect()
    for i, r in enumerate(got):
        assert r["u"] == int(hashlib.md5(f"7|op|{i}".encode()).hexdigest()[:8], 16) / 2**32


def test_bucketed_rank_equals_plain_window(cells):
    df = cells.withColumn("u", uniform(1, F.col("cell_id")))
    got = uniform_rank(df, "u", "cell_id", ["cell_type"], "rn", buckets=16)
    want = F.row_number().over(Window.partitionBy("cell_type").orderBy("u", "cell_id"))
    assert got.withColumn("w", want).where("rn <> w").count() == 0 and got.count() == 300


def test_running_sum_with_null_keys_and_values(spark):
    rows = [("a", 1.0, 2), ("a", 5.0, 3), (None, 1.0, 7), (None, 2.0, 1), ("a", 5.0, 4)]
    df = spark.createDataFrame(rows, "k string, x double, n int")
    out = running_sum(df, ["k"], width_bucket("x", F.lit(1.0), F.lit(5.0), 4), ["x", "n"], F.col("n"), "r")
    assert sorted((r["k"] or "", r["x"], r["r"]) for r in out.collect()) == [("", 1.0, 7), ("", 2.0, 8), ("a", 1.0, 2), ("a", 5.0, 5), ("a", 5.0, 9)]


def test_splits_are_exact_disjoint_and_complete(cells):
    got = splits.split_random(cells, 0.2)
    assert got.where("split = 'test'").count() == 60 and got.select("cell_id").distinct().count() == 300
    strat = {(r[0], r[1]): r[2] for r in splits.split_stratified(cells).groupBy("cell_type", "split").count().collect()}
    assert strat[("hot", "test")] == 40 and strat[("mid", "test")] == 20 and ("single", "test") not in strat


def test_draws_do_not_depend_on_partitioning(cells):
    a = splits.sample_ids(cells.repartition(7), 20).select("cell_id").collect()
    b = splits.sample_ids(cells.coalesce(1), 20).select("cell_id").collect()
    assert sorted(a) == sorted(b)


def test_random_ids_contain_the_asked_one_and_fail_when_short(cells):
    ids = [r[0] for r in splits.random_ids(cells, 10, 299).collect()]
    assert len(set(ids)) == 10 and 299 in ids
    with pytest.raises(Exception, match="larger than the table"):
        splits.random_ids(cells, 301, 0).collect()


def test_large_samples_take_the_ranked_way(cells, monkeypatch):
    small = sorted(r[0] for r in splits.sample_ids(cells, 30).select("cell_id").collect())
    monkeypatch.setattr(splits, "TOP_LIMIT", 5)
    assert sorted(r[0] for r in splits.sample_ids(cells, 30).select("cell_id").collect()) == small


def test_same_type_views_prefer_other_studies(cells):
    rows = views.same_type_views(cells, 5).join(cells.withColumnRenamed("study", "s2").withColumnRenamed("cell_type", "t2"), "cell_id")
    rows = rows.join(cells.select(F.col("cell_id").alias("anchor_id"), "study", "cell_type"), "anchor_id")
    assert rows.where("cell_type <> t2").count() == 0
    assert rows.where("view_no > 0 and study = s2 and cell_type <> 'single'").count() == 0
    per = views.same_type_views(cells, 5).where("view_no > 0").groupBy("anchor_id").agg(
        F.count("*").alias("n"), F.countDistinct("cell_id").alias("d"), F.min("complete").alias("c")
    )
    assert per.where("n <> d").count() == 0 and per.where("n < 4").count() == 1
    single = views.same_type_views(cells, 5).where("anchor_id = 299").orderBy("view_no").collect()
    assert [(r["view_no"], r["cell_id"], r["complete"]) for r in single] == [(0, 299, False), (1, 299, False)]


def test_fallback_pool_is_the_whole_label(spark):
    one_study = spark.createDataFrame([(i, "t", "s") for i in range(6)], "cell_id bigint, cell_type string, study string")
    got = views.same_type_views(one_study, 4)
    assert got.count() == 24 and got.where("not complete").count() == 0


def test_draws_cover_the_pool_evenly(cells):
    hot = cells.where("cell_type = 'hot'")
    hits = views.same_group_views(hot, "cell_type", 4).where("view_no > 0").groupBy("cell_id").count()
    n = hits.agg(F.count("*"), F.max("count")).first()
    assert n[0] > 180 and n[1] < 15


def test_partner_has_the_same_label(cells):
    p = views.one_partner(cells)
    j = p.join(cells.select(F.col("cell_id").alias("anchor_id"), F.col("cell_type").alias("a")), "anchor_id").join(
        cells.select(F.col("cell_id").alias("partner_id"), F.col("cell_type").alias("b")), "partner_id"
    )
    assert j.count() == 300 and j.where("a <> b").count() == 0


def test_walk_with_zero_weights_is_uniform_and_stays_on_the_graph(spark):
    knn = spark.createDataFrame([(0, 1, 1, 0.0), (0, 2, 2, 0.0), (1, 0, 1, 1.0), (2, 0, 1, 1.0)], "src bigint, dst bigint, rank int, dist double")
    anchors = spark.createDataFrame([(0,)], "cell_id bigint")
    got = {r["cell_id"] for r in views.random_walk_views(knn, anchors, 60, longest=1).where("view_no > 0").collect()}
    assert got == {1, 2}


def test_noise_is_repeatable_and_never_negative(vectors):
    df = vectors([[1.0, 0.0, -5.0]] * 20)
    a = views.noise_views(df, [2.0, 0.0, 1.0], [3.0, 1.0, 1.0], 2).collect()
    b = views.noise_views(df.repartition(5), [2.0, 0.0, 1.0], [3.0, 1.0, 1.0], 2).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert all(min(r["vec"]) >= 0 and r["vec"][1] == 0.0 for r in a)


def test_mask_rate(spark):
    counts = spark.range(4000).select(F.col("id").alias("cell_id"), F.lit(1).cast("bigint").alias("gene_id"), F.lit(1.0).alias("x"))
    kept = views.mask_views(counts, 2, 0.2).count() / 8000
    assert abs(kept - 0.8) < 0.03

import os

import pytest
from pyspark.sql import functions as F

from cytoweave.bundle import Bundle, validate, violations
from cytoweave.plans import source_queries
from cytoweave.sources import catalog, mtx, results
from cytoweave.streaming import streams


@pytest.fixture
def bundle(spark):
    cells = spark.createDataFrame([(1, "a", "s", "s"), (2, "b", "s", "s")], "cell_id bigint, cell_type string, study string, batch string")
    genes = spark.createDataFrame([(1, "MT-1", True), (2, "X", False)], "gene_id bigint, gene_name string, mt boolean")
    counts = spark.createDataFrame([(1, 1, 2.0), (2, 2, 3.0)], "cell_id bigint, gene_id bigint, x double")
    return Bundle(cells, genes, counts)


def test_bundle_round_trip(spark, bundle, tmp_path):
    catalog.write_annotated(bundle, str(tmp_path))
    back = catalog.read_annotated(spark, str(tmp_path))
    assert back.embeddings is None and back.counts.count() == 2
    assert violations(back).count() == 0


def test_validation_names_the_column(spark, bundle):
    with pytest.raises(ValueError, match="cell_type"):
        validate(bundle.with_(cells=bundle.cells.drop("cell_type")))


def test_violations_count_orphans_and_duplicates(spark, bundle):
    extra = spark.createDataFrame([(9, 1, 1.0)], bundle.counts.schema)
    bad = bundle.with_(counts=bundle.counts.unionAll(extra), cells=bundle.cells.unionAll(bundle.cells.limit(1)))
    got = {r["check"]: r["n"] for r in violations(bad).collect()}
    assert got == {"orphan_count": 1, "duplicate_cell": 1}


def test_single_file_mtx_with_an_entry_like_the_size_line(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% c\n2 3 3\n1 1 5\n2 3 3\n2 1 7\n")
    (tmp_path / "barcodes.tsv").write_text("AA\nBB\nCC\n")
    (tmp_path / "genes.tsv").write_text("id1\tMT-A\nid2\tB\n")
    b = mtx.read_mtx(spark, str(tmp_path))
    got = sorted((r["cell_id"], r["gene_id"], r["x"]) for r in b.counts.collect())
    assert got == [(1, 1, 5.0), (1, 2, 7.0), (3, 2, 3.0)]
    assert [(r["gene_id"], r["gene_name"], r["mt"]) for r in b.genes.orderBy("gene_id").collect()] == [(1, "MT-A", True), (2, "B", False)]
    assert [r["barcode"] for r in b.cells.orderBy("cell_id").collect()] == ["AA", "BB", "CC"]


def test_lines_are_numbered_by_part_name_not_by_listing(spark, tmp_path):
    names = [f"part-{i:05d}.txt" for i in range(40)]
    for name in reversed(names):
        (tmp_path / name).write_text(f"{name} a\n{name} b\n")
    got = [r["value"] for r in mtx._numbered_lines(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [f"{name} {x}" for name in names for x in "ab"]


def test_read_mtx_with_key_gaps_and_equal_names(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    save("customer", [(5, "C"), (90, "C"), (7000, "D")], "c_custkey bigint, c_name string")
    save("part", [(3, "p", "Brand#11"), (800, "p", "Brand#21")], "p_partkey bigint, p_name string, p_brand string")
    save("orders", [(10, 5), (2000, 90), (30, 7000)], "o_orderkey bigint, o_custkey bigint")
    save("lineitem", [(10, 3, 1.0), (2000, 3, 2.0), (30, 800, 4.0), (10, 800, 8.0)], "l_orderkey bigint, l_partkey bigint, l_quantity double")
    got = {tuple(r) for r in source_queries.read_mtx(spark, str(tmp_path)).collect()}
    assert got == {("C", "p_3", 3.0), ("C", "p_800", 8.0), ("D", "p_800", 4.0)}


def test_a_stream_reads_a_file_and_a_folder_of_parts_alike(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "n")
    rows.repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next(f for f in os.listdir(tmp_path / "one") if f.endswith(".parquet"))
    os.rename(tmp_path / "one" / part, tmp_path / "file.parquet")
    for name in ("parts", "file"):
        out = str(tmp_path / f"out_{name}")
        streams.append_to(streams.parquet_stream(spark, str(tmp_path), f"{name}.parquet", "n bigint"), out, str(tmp_path / f"ck_{name}")).awaitTermination()
        assert sorted(r[0] for r in spark.read.schema("n bigint").parquet(out).collect()) == list(range(20))


def test_cached_graph_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, 2)], "src bigint, dst bigint")

    path = results.graph_path(str(tmp_path), "d", 2, "pca", 50, 10)
    assert results.cached_graph(spark, path, build).count() == 1
    assert results.cached_graph(spark, path, build).count() == 1
    assert calls == [1]


def test_reuse_computes_only_missing(spark, tmp_path):
    path = str(tmp_path / "m")
    wanted = spark.createDataFrame([("m", "q", "f1"), ("m", "q", "ari")], "model string, split string, metric string")
    seen = []

    def compute(todo):
        seen.append(todo.count())
        return todo.withColumn("value", F.lit(1.0))

    results.reuse_or_compute(spark, path, wanted.where("metric = 'f1'"), compute)
    out = results.reuse_or_compute(spark, path, wanted, compute)
    assert out.count() == 2 and seen == [1, 1]


def test_label_dictionary_gives_null_for_unknown(spark):
    d = catalog.fit_label_dictionary(spark.createDataFrame([("b",), ("a",), ("b",)], "cell_type string"))
    assert {r["label"]: r["label_id"] for r in d.collect()} == {"a": 0, "b": 1}
    got = catalog.encode_labels(spark.createDataFrame([("z",)], "cell_type string"), d).first()
    assert got["label_id"] is None


def _files(spark, folder, parts):
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "bank_no int, cell_id bigint, vec array<double>, step bigint")
        df.coalesce(1).write.mode("append").parquet(folder)
        assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) == i + 1


def test_bank_stream_over_several_batches_and_a_restart(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "bank_no int, cell_id bigint, vec array<double>, step bigint"
    _files(spark, folder, [[(0, 1, [1.0], 1), (0, 2, [1.0], 1)], [(0, 1, [5.0], 9)]])
    read = lambda: streams.parquet_stream(spark, folder, "*.parquet", schema, files_per_trigger=1)
    streams.maintain_bank(read(), out, ck).awaitTermination()
    spark.createDataFrame([(0, 2, [7.0], 3)], schema).coalesce(1).write.mode("append").parquet(folder)
    streams.maintain_bank(read(), out, ck).awaitTermination()
    got = {r["cell_id"]: r["vec"] for r in streams.read_bank(spark, out).collect()}
    assert got == {1: [5.0], 2: [7.0]}
    streams.compact_bank(spark, out, str(tmp_path / "compact"))
    assert streams.read_bank(spark, str(tmp_path / "compact")).count() == 2


def test_epoch_stream_sums_across_batches(spark, tmp_path):
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for v in (1.0, 4.0):
        spark.sql(f"select timestamp'2024-01-01 10:00:00' as ts, {v}D as value, 1 as n").coalesce(1).write.mode("append").parquet(folder)
    s = streams.parquet_stream(spark, folder, "*.parquet", "ts timestamp, value double, n int", files_per_trigger=1)
    streams.keep_updates(streams.epoch_averages(s, "ts", "value", "n"), out, ck).awaitTermination()
    rows = streams.latest_updates(spark, out, "epoch").collect()
    assert len(rows) == 1 and rows[0]["avg"] == 2.5

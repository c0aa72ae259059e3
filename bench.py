"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data
and cores; BENCH_QUERIES is an optional comma list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cytoweave.plans import registry  # noqa: E402
from cytoweave.session import local_session  # noqa: E402

HEADLINE = [
    "knn_squared_l2",
    "knn_cosine",
    "same_label_fraction",
    "nearest_prototype",
    "prototype_purity",
    "sinkhorn",
    "sinkhorn_by_batch",
    "swapped_cross_entropy",
    "contrastive_score",
    "spherical_kmeans",
    "normalize_total",
    "variable_genes",
    "stabilised_variance",
    "scale_sparse",
    "type_profiles",
    "rank_sum",
    "welch_markers",
    "split_stratified",
    "same_type_views",
    "random_walk_views",
    "knn_predictions",
    "label_silhouette",
    "graph_connectivity",
    "label_graph_scores",
    "point_density",
]


def scaled(spark, sf_dir: str) -> dict[str, dict[str, float]]:
    """Seconds, and microseconds per row, of three operators on more rows than the table has.

    Rows of ``embeddings`` are repeated with a keyed shift, so copies stay neighbours but are not equal.
    """
    from pyspark.sql import functions as F

    from cytoweave.functions.rand import uniform
    from cytoweave.operators import assign, neighbors, proto
    from cytoweave.plans import tables
    from cytoweave.session import cut_lineage

    base, protos = tables.emb(spark, sf_dir), cut_lineage(tables.protos(spark, sf_dir))
    n = base.count()
    out = {}
    jobs = {
        "knn_probed": lambda c: neighbors.knn_graph(c, 10, nprobe=4),
        "nearest_prototype": lambda c: proto.nearest_prototype(c, protos),
        "sinkhorn": lambda c: assign.sinkhorn(proto.score_arrays(c, protos)),
    }
    for times in (10, 100):
        shift = lambda x, i: x + 0.1 * uniform("copy", F.col("cell_id"), F.col("_t"), i)
        more = base.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_t"), "vec").select(
            (F.col("cell_id") * times + F.col("_t")).alias("cell_id"), F.transform("vec", shift).alias("vec")
        )
        more = cut_lineage(more)
        for name, job in jobs.items():
            if name == "knn_probed" and times > 10:
                continue
            start = time.perf_counter()
            job(more).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            out[f"{name}_x{times}"] = {"sec": round(took, 3), "us_per_row": round(1e6 * took / (n * times), 2)}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    registry.load_all()
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    run = lambda name: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("value_counts")  # start the JVM and a Python worker outside the clock
    run("nearest_prototype")
    times = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    more = scaled(spark, sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "scaled": more,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

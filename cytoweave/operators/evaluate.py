"""Classification scores, result tables and point density."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from .neighbors import knn_join
from .prep import pca
from .relate import stack_tagged
from .select import drop_singletons
from .splits import split_random, split_stratified
from .tiles import pack, pair_within, tile_map, unpack

# --- classifiers -----------------------------------------------------------------------------------


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, label: str = "cell_type") -> DataFrame:
    """Majority vote of the k nearest training rows; a tie goes to the smallest label."""
    near = knn_join(test.select("cell_id", "vec"), train.select("cell_id", "vec"), k, "l2")
    votes = (
        near.join(train.select(F.col("cell_id").alias("dst"), F.col(label).alias("_l")), "dst")
        .groupBy("src", "_l")
        .agg(F.count("*").alias("_n"))
    )
    best = votes.groupBy("src").agg(F.min_by("_l", F.struct(F.negative("_n"), F.col("_l"))).alias("y_pred"))
    return test.select("cell_id", F.col(label).alias("y_true")).join(best, F.col("cell_id") == F.col("src")).select(
        "cell_id", "y_true", "y_pred"
    )


def knn_evaluation(cells: DataFrame, k: int = 5, test_size: float = 0.2, seed: int = 42, label: str = "cell_type") -> DataFrame:
    """Stratified split of the labels with two cells or more, kNN vote: predictions of the test part."""
    split = split_stratified(drop_singletons(cells, label), label, test_size, seed)
    return knn_classify(split.where("split = 'train'"), split.where("split = 'test'"), k, label)


def linear_classify(train: DataFrame, test: DataFrame, label: str = "cell_type", max_iter: int = 1000, reg: float = 0.0) -> DataFrame:
    """Multinomial logistic regression on the vectors, until the fit settles (``max_iter`` at most)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer

    feats = lambda df: df.select("cell_id", label, array_to_vector(F.col("vec")).alias("_f"))
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep")
    fitted = indexer.fit(feats(train))
    model = LogisticRegression(featuresCol="_f", labelCol="_y", predictionCol="_p", maxIter=max_iter, regParam=reg, family="multinomial")
    trained = model.fit(fitted.transform(feats(train)))
    back = IndexToString(inputCol="_p", outputCol="y_pred", labels=fitted.labels)
    scored = back.transform(trained.transform(feats(test).withColumn("_y", F.lit(0.0))))
    return scored.select("cell_id", F.col(label).alias("y_true"), "y_pred")


def linear_evaluation(cells: DataFrame, test_size: float = 0.2, seed: int = 42, label: str = "cell_type", **kw) -> DataFrame:
    """Unstratified split, linear classifier: predictions of the test part."""
    split = split_random(cells, test_size, seed)
    return linear_classify(split.where("split = 'train'"), split.where("split = 'test'"), label, **kw)


def reference_evaluation(ref: DataFrame, query: DataFrame, label: str = "cell_type", **kw) -> DataFrame:
    """Linear classifier fitted on the reference cells: predictions of the query cells."""
    return linear_classify(ref, query, label, **kw)


def evaluate_keys(
    keys: dict[str, tuple[DataFrame, DataFrame]], subsets: dict[str, Sequence[str] | None], label: str = "cell_type", **kw
) -> DataFrame:
    """Macro F1 on the query cells, for every embedding key ``(ref, query)`` and label subset."""
    out = None
    for key, parts in keys.items():
        for name, labels in subsets.items():
            ref, query = parts if labels is None else (p.where(F.col(label).isin(list(labels))) for p in parts)
            scores = f1_summary(f1_per_class(reference_evaluation(ref, query, label, **kw)))
            row = scores.select(F.lit(key).alias("model"), F.lit(name).alias("subset"), F.col("f1_macro"))
            out = row if out is None else out.unionAll(row)
    return out


def results_by_key(keys: dict[str, DataFrame], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a metric function to each embedding key and stack the rows."""
    out = None
    for key, df in keys.items():
        row = score(df).withColumn("model", F.lit(key))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


# --- classification scores ----------------------------------------------------------------------------


def f1_per_class(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class (zero division gives 0).

    Each prediction speaks once as truth and once as prediction, so one partial
    aggregate covers classes seen on either side.
    """
    hit = (F.col("y_true") == F.col("y_pred")).cast("bigint")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    truth = F.struct(F.col("y_true").alias("c"), one.alias("t"), none.alias("p"), hit.alias("h"))
    said = F.struct(F.col("y_pred").alias("c"), none.alias("t"), one.alias("p"), none.alias("h"))
    counts = predictions.select(F.explode(F.array(truth, said)).alias("e")).groupBy(F.col("e.c").alias("class")).agg(
        F.sum("e.t").alias("support"), F.sum("e.p").alias("predicted"), F.sum("e.h").alias("tp")
    )
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select(
        "class",
        div(F.col("tp"), F.col("predicted")).alias("precision"),
        div(F.col("tp"), F.col("support")).alias("recall"),
        div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "predicted",
        "tp",
    )


def f1_summary(per_class: DataFrame) -> DataFrame:
    """Micro, macro and support-weighted F1."""
    return per_class.agg(
        (2 * F.sum("tp") / (F.sum("support") + F.sum("predicted"))).alias("f1_micro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def named_f1(summary: DataFrame, model: str, prefix: str) -> DataFrame:
    """Summary under its report names: ``<prefix> macro / micro / weighted``."""
    return summary.select(
        F.lit(model).alias("model"), *[F.col(f"f1_{k}").alias(f"{prefix} {k}") for k in ("macro", "micro", "weighted")]
    )


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def accuracy_per_class(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(F.col("y_true").alias("class")).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n")
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    return f1_per_class(predictions).select("class", "precision", "recall", "f1", "support")


def top_k_accuracy(scores: DataFrame, truth: str, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Share of rows whose true position is among the k best scores.

    ``s`` is an array in class order and ``truth`` the 0-based true position; the
    rank is counted inside the row, so nothing is sorted or shuffled.
    """
    own = F.element_at("s", F.col(truth) + 1)
    ahead = F.transform(
        "s",
        lambda x, i: F.when((x > F.col("_own")) | ((x == F.col("_own")) & (i < F.col(truth))), 1).otherwise(0),
    )
    ranked = scores.withColumn("_own", own).withColumn("_r", F.aggregate(ahead, F.lit(0), lambda a, x: a + x))
    return ranked.agg(*[F.avg((F.col("_r") < k).cast("double")).alias(f"top{k}") for k in ks])


# --- result tables ---------------------------------------------------------------------------------------


def compare_models(frames: DataFrame, fold: str, columns: Sequence[str], digits: int = 5) -> DataFrame:
    """Mean over folds, chosen columns, rounded, duplicates removed, best first."""
    mean = frames.groupBy("model").agg(*[F.avg(c).alias(c) for c in columns])
    tidy = mean.withColumns({c: F.round(c, digits) for c in columns}).dropDuplicates()
    return tidy.orderBy(F.desc(columns[0]), "model")


def split_metrics(cells: DataFrame, split: Column, metric: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same metric for reference, query and all cells."""
    tagged = cells.withColumn("_s", split)
    parts = {"ref": tagged.where("_s = 'ref'"), "query": tagged.where("_s = 'query'"), "all": tagged}
    out = None
    for name, part in parts.items():
        row = metric(part.drop("_s")).withColumn("split", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def duplicate_categories(categories: DataFrame, column: str) -> DataFrame:
    """Values listed more than once."""
    return categories.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


# --- display tables ----------------------------------------------------------------------------------------


def joint_projection(cells: DataFrame, protos: DataFrame) -> DataFrame:
    """Cells and prototypes in one plane: joint two-component projection."""
    tagged = stack_tagged({"cell": (cells, "cell_id"), "prototype": (protos, "proto_id")})
    scores, _ = pca(tagged, 2)
    return scores.select("type", "id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


def _whitened(points: DataFrame) -> tuple[DataFrame, float]:
    """``_u, _v``: coordinates in which the kernel is a standard normal product, and the kernel's scale.

    Full 2 x 2 covariance, bandwidth n ** (-1/6).
    """
    m = points.agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cxy"),
    ).first()
    n = m["n"]
    cov = np.array([[m["vx"], m["cxy"]], [m["cxy"], m["vy"]]]) * n ** (-1.0 / 3.0)
    inv = np.linalg.inv(np.linalg.cholesky(cov))
    u = (F.col("x") - m["mx"]) * float(inv[0, 0])
    v = (F.col("x") - m["mx"]) * float(inv[1, 0]) + (F.col("y") - m["my"]) * float(inv[1, 1])
    return points.withColumns({"_u": u, "_v": v}), 1.0 / (n * 2.0 * math.pi * math.sqrt(np.linalg.det(cov)))


def point_density(points: DataFrame) -> DataFrame:
    """Exact Gaussian kernel density at every point ``(cell_id, x, y)``; adds ``density``.

    Sums tile against tile, which is quadratic in the points by definition;
    :func:`mesh_density` is the linear form a caller may choose instead.
    """
    white, scale = _whitened(points)
    tiles = pack(white.select("cell_id", F.array("_u", "_v").alias("vec")), [])

    def kernel(row: dict) -> pa.RecordBatch:
        a, x = unpack(row["rows"])
        _, y = unpack(row["other"])
        d = np.exp(-0.5 * V.cross_l2sq(x, y)).sum(1) * scale
        return pa.record_batch([pa.array(a), pa.array(d)], names=["cell_id", "d"])

    pairs = pair_within(tiles, tiles, [], []).select("rows", "other")
    sums = tile_map(pairs, kernel, "cell_id bigint, d double").groupBy("cell_id").agg(F.sum("d").alias("density"))
    return points.join(sums, "cell_id")


# kernel values beyond so many bandwidths are below 1e-7 of the peak
REACH = 5.7


def mesh_density(points: DataFrame, step: float = 0.0625) -> DataFrame:
    """Density read from a mesh whose step is a fraction of the bandwidth, so outliers do not coarsen it.

    A point is shared out linearly among the four mesh nodes around it; the sums are smoothed along one
    axis, then along the other, by exploding each node over its reach; a point reads its four nodes back
    by the same weights.  Only nodes in use exist, as rows.  The error is of order ``step ** 2``.
    """
    white, scale = _whitened(points)
    part = lambda c: F.col(c) / step - F.floor(F.col(c) / step)
    node = lambda c, d: (F.floor(F.col(c) / step) + d).cast("bigint")
    share = lambda c, d: part(c) if d else 1.0 - part(c)
    corners = F.array(*[F.struct(node("_u", a).alias("i"), node("_v", b).alias("j"), (share("_u", a) * share("_v", b)).alias("w")) for a in (0, 1) for b in (0, 1)])
    shared = white.select("cell_id", F.explode(corners).alias("_n")).select("cell_id", "_n.i", "_n.j", "_n.w")
    used = shared.groupBy("i", "j").agg(F.sum("w").alias("c"))
    reach = int(math.ceil(REACH / step))
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    weight = F.exp(-0.5 * F.pow(F.col("o") * step, F.lit(2.0)))
    along = used.select("*", offsets.alias("o")).groupBy((F.col("i") + F.col("o")).alias("i"), "j").agg(F.sum(F.col("c") * weight).alias("c"))
    # only rows of the mesh that hold points are asked for
    asked = along.join(used.select("i").distinct(), "i", "left_semi")
    both = asked.select("*", offsets.alias("o")).groupBy("i", (F.col("j") + F.col("o")).alias("j")).agg((F.sum(F.col("c") * weight) * scale).alias("d"))
    read = shared.join(both, ["i", "j"]).groupBy("cell_id").agg(F.sum(F.col("w") * F.col("d")).alias("density"))
    return points.join(read, "cell_id")

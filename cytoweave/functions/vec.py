"""Vector columns: JVM expressions for short work, Arrow kernels for matrices.

Kernels see Arrow batches as numpy matrices without per-row Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_double(vec: str | Column) -> Column:
    col = F.col(vec) if isinstance(vec, str) else vec
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def unit(vec: str | Column) -> Column:
    """Divide by the L2 norm; a zero vector stays zero."""
    col = F.col(vec) if isinstance(vec, str) else vec
    n = norm(col)
    return F.when(n > 0, F.transform(col, lambda x: x / n)).otherwise(col)


def mean_vector(vec: str) -> Column:
    """Aggregate: element-wise mean (partial sums per task, no explode)."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vec))))


def variance_vector(vec: str) -> Column:
    """Aggregate: element-wise sample variance."""
    return vector_to_array(Summarizer.variance(array_to_vector(F.col(vec))))


# --- Arrow kernels -------------------------------------------------------------


def matrix(col: pa.ListArray) -> np.ndarray:
    """List column of equal-length vectors as an (n, d) float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(n, -1)


def row_lists(m: np.ndarray) -> pa.ListArray:
    """(n, d) matrix as a list column."""
    n, d = m.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.reshape(-1), type=pa.float64()))


def cross_l2sq(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between two blocks, floored at zero."""
    d2 = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (q @ b.T)
    return np.maximum(d2, 0.0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def unit_kernel():
    """Arrow form of :func:`unit` for whole tables of wide vectors."""
    return F.arrow_udf(lambda col: row_lists(unit_rows(matrix(col))), T.ArrayType(T.DoubleType()))

"""Checked size bounds for anything that is sent whole to every task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 4 Mi doubles = 32 MiB per task
MAX_ELEMENTS = 4 * 1024 * 1024
MAX_ROWS = 4096


def bounded_matrix(
    df: DataFrame, id_col: str, vec_col: str, max_rows: int = MAX_ROWS
) -> tuple[np.ndarray, np.ndarray] | None:
    """``(ids, matrix)`` if the table is provably small, else ``None``.

    Rows and elements are counted before any row is sent; callers must have a
    distributed way for the ``None`` case.
    """
    size = df.agg(F.count("*"), F.sum(F.size(vec_col).cast("bigint"))).first()
    if size[0] > max_rows or (size[1] or 0) > MAX_ELEMENTS:
        return None
    rows = df.select(F.col(id_col), F.col(vec_col).cast("array<double>")).collect()
    rows.sort(key=lambda r: r[0])
    ids = np.array([r[0] for r in rows])
    mat = np.array([r[1] for r in rows], dtype=np.float64)
    return ids, mat

"""Blocks of vectors ("tiles") as rows.

Pair computations run tile against tile: Spark shuffles bounded tiles by
equi-join and a numpy kernel reduces each pair of tiles to its answer (top-k or
partial sums) inside the task.  Pairs of single rows never exist as Spark rows,
and a hot label is simply many tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TILE = 1024


def pack(df: DataFrame, keys: Sequence[str], rows_per_tile: int = ROWS_PER_TILE, extra: Sequence[str] = ()) -> DataFrame:
    """Rows ``(cell_id, vec)`` of each key packed into tiles of about ``rows_per_tile`` rows.

    Output: keys, ``salt``, ``rows`` = array of struct(cell_id, vec, *extra).
    The salt is a hash of the id, so a key of any size splits evenly.
    """
    keys = list(keys)
    body = F.struct("cell_id", F.col("vec").cast("array<double>").alias("vec"), *extra)
    if keys:
        salts = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_tile).alias("_t"))
        sized = df.join(salts, keys)
    else:
        n = df.agg(F.greatest(F.ceil(F.count("*") / rows_per_tile), F.lit(1))).scalar()
        sized = df.withColumn("_t", n)
    salt = F.pmod(F.xxhash64("cell_id"), F.col("_t").cast("bigint")).cast("int")
    return sized.withColumn("salt", salt).groupBy(*keys, "salt").agg(F.collect_list(body).alias("rows"))


def pair_within(left: DataFrame, right: DataFrame, scope: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Every left tile with every right tile of the same scope.

    Per scope only the tile count of every right key is listed; salts are exploded from
    it, so the join is an equi-join on the full tile address, a large scope spreads
    over it, and nothing that grows with the rows is copied to each tile.
    Output: left columns, right keys, ``rows`` of the left and ``other`` of the right.
    """
    scope, right_keys = list(scope), list(right_keys)
    address = [c for c in [*right_keys, "salt"] if c not in scope]
    inner = [c for c in address if c != "salt"]
    counts = right.groupBy(*scope, *inner).agg((F.max("salt") + 1).alias("_n"))
    listed = F.collect_list(F.struct(*inner, "_n")).alias("_adr")
    if scope:
        routed = left.join(counts.groupBy(*scope).agg(listed), scope)
    else:
        routed = left.withColumn("_adr", counts.agg(listed).scalar())
    routed = routed.withColumn("_key", F.explode("_adr")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_key._n") - 1)))
    routed = routed.withColumn("_to", F.struct(*[F.col("_key")[c].alias(c) for c in inner], F.col("_salt").alias("salt"))).drop("_adr", "_key", "_salt")
    target = right.select(
        *[F.col(c).alias(f"_r_{c}") for c in [*scope, *address]], F.col("rows").alias("other")
    )
    on = [F.col(c) == F.col(f"_r_{c}") for c in scope] + [F.col("_to")[c] == F.col(f"_r_{c}") for c in address]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    # sizes are estimated before the explode: tiles that look small could be broadcast with all their copies
    joined = routed.hint("merge").join(target, cond)
    keep = [F.col(c) for c in left.columns]
    extra = [F.col(f"_r_{c}").alias(f"other_{c}") for c in right_keys if c not in scope]
    return joined.select(*keep, *extra, "other")


def unpack(rows: pa.StructArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of one tile."""
    return np.asarray(rows.field("cell_id")), _mat(rows.field("vec"))


def _mat(lists: pa.ListArray) -> np.ndarray:
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    return flat.reshape(len(lists), -1)


def tile_map(df: DataFrame, kernel: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``kernel`` to each tile-pair row; it returns a small RecordBatch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {}
                for name, col in zip(names, batch.columns):
                    # list columns become the slice of their child; scalars stay scalars
                    row[name] = col[i].values if pa.types.is_list(col.type) else col[i].as_py()
                out = kernel(row)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)

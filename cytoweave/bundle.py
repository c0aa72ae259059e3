"""The annotated matrix as a bundle of keyed DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = T.StructType(
    [
        T.StructField("cell_id", T.LongType()),
        T.StructField("cell_type", T.StringType()),
        T.StructField("study", T.StringType()),
        T.StructField("batch", T.StringType()),
    ]
)
GENES = T.StructType(
    [
        T.StructField("gene_id", T.LongType()),
        T.StructField("gene_name", T.StringType()),
        T.StructField("mt", T.BooleanType()),
    ]
)
COUNTS = T.StructType(
    [
        T.StructField("cell_id", T.LongType()),
        T.StructField("gene_id", T.LongType()),
        T.StructField("x", T.DoubleType()),
    ]
)
EMBEDDINGS = T.StructType(
    [
        T.StructField("cell_id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())),
    ]
)
SCHEMAS = {"cells": CELLS, "genes": GENES, "counts": COUNTS, "embeddings": EMBEDDINGS}


@dataclass(frozen=True)
class Bundle:
    """``counts`` is sparse: an absent (cell, gene) row means zero."""

    cells: DataFrame
    genes: DataFrame | None = None
    counts: DataFrame | None = None
    embeddings: DataFrame | None = None
    flags: dict = field(default_factory=dict)

    def parts(self) -> dict[str, DataFrame]:
        named = {k: getattr(self, k) for k in SCHEMAS}
        return {k: v for k, v in named.items() if v is not None}

    def with_(self, **changes) -> "Bundle":
        return replace(self, **changes)


def validate(bundle: Bundle) -> None:
    """Required columns are present with the required types; raises ``ValueError``."""
    for name, df in bundle.parts().items():
        have = {f.name: f.dataType for f in df.schema.fields}
        for want in SCHEMAS[name].fields:
            if want.name not in have:
                raise ValueError(f"{name}: column {want.name} is missing")
            if have[want.name].simpleString() != want.dataType.simpleString():
                raise ValueError(
                    f"{name}.{want.name}: {have[want.name].simpleString()}, "
                    f"expected {want.dataType.simpleString()}"
                )


def violations(bundle: Bundle) -> DataFrame:
    """Rows per broken constraint: NULL labels, duplicate keys, orphan counts."""
    checks = [
        bundle.cells.where(F.col("cell_type").isNull()).select(F.lit("null_cell_type").alias("check")),
        bundle.cells.groupBy("cell_id").count().where("count > 1").select(F.lit("duplicate_cell").alias("check")),
    ]
    if bundle.counts is not None:
        checks.append(
            bundle.counts.join(bundle.cells, "cell_id", "left_anti").select(F.lit("orphan_count").alias("check"))
        )
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out.groupBy("check").agg(F.count("*").alias("n"))

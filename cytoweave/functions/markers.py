"""Marker genes of immune cell types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: marker genes per cell type
IMMUNE_MARKERS = {
    "CD4+ T cells": ["CD4", "STAT5A", "FOXP3", "IL2RA"],
    "CD8+ T cells": ["CD8A", "CD8B1", "GZMA", "PRF1"],
    "CD10+ B cells": ["MME", "CD19", "CD20", "CR2"],
    "CD14+ Monocytes": ["CD14", "LYZ", "CSF1R", "ITGAM"],
    "CD16+ Monocytes": ["FCGR3A", "FCGR3B", "NCR1", "LILRA1"],
    "CD20+ B cells": ["MS4A1", "CD19", "CR2", "PAX5"],
    "Erythrocytes": ["HBB", "HBA1", "HBA2", "EPOR"],
    "Erythroid progenitors": ["GATA1", "KLF1", "EPOR", "HBB"],
    "HSPCs": ["CD34", "PROM1", "THY1", "KIT"],
    "Megakaryocyte progenitors": ["ITGA2B", "GP9", "PF4", "MYB"],
    "Monocyte progenitors": ["CD14", "CSF1R", "ITGAM", "LYZ"],
    "Monocyte-derived dendritic cells": ["CD1C", "CD83", "CSF2", "IL3"],
    "NK cells": ["NCAM1", "KLRD1", "NKG7", "FCGR3A"],
    "NKT cells": ["NCAM1", "FCGR3A", "NKG7", "KLRB1"],
    "Plasma cells": ["SDC1", "CD38", "IGHG1", "XBP1"],
    "Plasmacytoid dendritic cells": ["CLEC4C", "IL3RA", "LILRA4", "IRF7"],
}


def marker_table(spark: SparkSession, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """``(cell_type, gene_name)`` rows of a marker dictionary."""
    rows = list((markers or IMMUNE_MARKERS).items())
    listed = spark.createDataFrame(rows, "cell_type string, genes array<string>")
    return listed.select("cell_type", F.explode("genes").alias("gene_name"))


def known_markers(spark: SparkSession, genes: DataFrame, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """Markers that exist in ``genes``, one row per (cell type, gene)."""
    return marker_table(spark, markers).join(genes.select("gene_id", "gene_name"), "gene_name")

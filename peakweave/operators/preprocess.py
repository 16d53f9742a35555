"""Filters before inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_zeros(counts: DataFrame) -> DataFrame:
    return counts.where("value <> 0")


def filter_regions(counts: DataFrame, regions: DataFrame, min_cells: int = 0, min_counts: float = 0) -> DataFrame:
    """Regions that are seen in ``min_cells`` cells and have ``min_counts`` counts."""
    seen = counts.groupBy("idx").agg(F.count("*").alias("n"), F.sum("value").alias("total")).where((F.col("n") >= min_cells) & (F.col("total") >= min_counts))
    return regions.join(seen.select("idx"), "idx", "left_semi")


def filter_cells(counts: DataFrame, min_regions: int) -> DataFrame:
    """Counts of the cells that have ``min_regions`` regions."""
    keep = counts.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= min_regions)
    return counts.join(keep.select("cell"), "cell", "left_semi")


def empty_regions(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions without a count."""
    return regions.join(counts.where("value <> 0").select("idx"), "idx", "left_anti")

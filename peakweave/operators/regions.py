"""Regions: names to coordinates, order, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str], error: type[Exception] = KeyError) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise error(f"missing columns: {', '.join(missing)}")


def name_parts(name: Column, sep: tuple[str, str] = ("_", "_")) -> Column:
    """The parts of a region's name, either separator counting as the first."""
    return F.split(F.replace(name, F.lit(sep[1]), F.lit(sep[0])), rf"\Q{sep[0]}\E")


def parse_regions(df: DataFrame, name: str = "peak", sep: tuple[str, str] = ("_", "_")) -> DataFrame:
    """Add chromosome, start and end from names of three parts; ValueError if a name has more or fewer."""
    require_columns(df, [name])
    parts = name_parts(F.col(name), sep)
    if df.agg(F.max(F.coalesce((F.size(parts) != 3).cast("int"), F.lit(1)))).first()[0]:
        raise ValueError(f"region names must be chromosome{sep[0]}start{sep[1]}end")
    number = lambda k: parts.getItem(k).cast("bigint")
    return df.withColumns({"chromosome": parts.getItem(0), "start": number(1), "end": number(2)})


def sort_regions(df: DataFrame, name: str = "peak") -> DataFrame:
    """Add ``idx``, the place in the order by chromosome (as text), start, end and name; ordering is per chromosome."""
    require_columns(df, ["chromosome", "start"])
    within = Window.partitionBy("chromosome").orderBy("start", "end", name)
    sizes = df.groupBy("chromosome").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("chromosome").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("chromosome", before.alias("before"))  # a row a chromosome
    placed = df.withColumn("rank", F.row_number().over(within).cast("bigint"))
    return placed.join(F.broadcast(offsets), "chromosome").withColumn("idx", F.col("before") + F.col("rank") - 1).drop("before", "rank")


def add_region_infos(df: DataFrame, name: str = "peak", sep: tuple[str, str] = ("_", "_")) -> DataFrame:
    """Coordinates and order of regions from their names."""
    return sort_regions(parse_regions(df, name, sep), name)


def in_region(chromosome: str, start: int, end: int) -> Column:
    """On the chromosome with the start or the end in [start, end]; regions that contain it are not in it."""
    return (F.col("chromosome") == chromosome) & (F.col("start").between(start, end) | F.col("end").between(start, end))


def subset_region(regions: DataFrame, chromosome: str, start: int, end: int) -> DataFrame:
    require_columns(regions, ["chromosome", "start", "end"])
    return regions.where(in_region(chromosome, start, end))


def subset_counts(counts: DataFrame, regions: DataFrame) -> DataFrame:
    """Counts of some regions only."""
    return counts.join(regions.select("idx"), "idx", "left_semi")


def subset_network(network: DataFrame, regions: DataFrame) -> DataFrame:
    """Links between some regions only."""
    keep = regions.select("idx")
    left = network.join(keep.withColumnRenamed("idx", "i"), "i", "left_semi")
    return left.join(keep.withColumnRenamed("idx", "j"), "j", "left_semi")

"""Readers, writers and projections of other tables onto the data model.

Model: ``counts(cell, idx, value)`` without zeros, ``regions(peak, chromosome, start, end, idx)``, ``network(i, j, score)`` with both
triangles, ``genes(chromosome, start, end, strand, genename)``, ``embedding(cell, vec)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.plotdata import normalize_genes
from ..operators.regions import add_region_infos


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts from Parquet, explicit zeros dropped."""
    return spark.read.parquet(path).select("cell", "idx", F.col("value").cast("double")).where("value <> 0")


def read_genes(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Genes from an annotation export in the five-column form of public gene databases."""
    return normalize_genes(spark.read.format(fmt).options(**options).load(path))


def counts_from_pandas(spark: SparkSession, frame, peak_names: list[str] | None = None, sep: tuple[str, str] = ("_", "_")) -> tuple[DataFrame, DataFrame, int]:
    """(counts, regions, n_cells) from a small cells x regions frame or matrix."""
    import numpy as np
    import pandas as pd

    names = list(peak_names if peak_names is not None else frame.columns)
    values = np.asarray(frame, float)
    cell, column = np.nonzero(values)
    regions = add_region_infos(spark.createDataFrame(pd.DataFrame({"peak": names, "column": range(len(names))})), sep=sep)
    raw = spark.createDataFrame(pd.DataFrame({"cell": cell, "column": column, "value": values[cell, column]}), "cell bigint, column bigint, value double")
    counts = raw.join(regions.select("column", "idx"), "column").select("cell", "idx", "value")
    return counts, regions.drop("column"), len(values)


def write_network(network: DataFrame, path: str, key: str = "atac_network") -> None:
    """A network under its key, as one partition of a table of networks."""
    network.withColumn("key", F.lit(key)).write.mode("overwrite").partitionBy("key").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_network(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """One network of a table of networks; KeyError if the key is unknown, or not given while there are none or several."""
    table = spark.read.parquet(path)
    keys = sorted(r.key for r in table.select("key").distinct().collect())
    return table.where(F.col("key") == choose_key(keys, key)).drop("key")


def choose_key(keys: list[str], key: str | None) -> str:
    if key is None:
        if len(keys) != 1:
            raise KeyError(f"{len(keys)} networks; name one of {keys}")
        return keys[0]
    if key not in keys:
        raise KeyError(f"no network {key!r}; there are {keys}")
    return key


# ------------------------------------------------------------------------------------------- projections


def lineitem_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as cells, parts as regions, summed quantities as counts: (cell, part, value).  They are dealt by part, as a join of their regions needs them."""
    rows = read_table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("part"), "l_quantity")
    return rows.repartition("part").groupBy("cell", "part").agg(F.sum("l_quantity").alias("value"))


def part_names(spark: SparkSession, folder: str, start: Column, sep: tuple[str, str] = ("_", "_")) -> DataFrame:
    """(part, peak): a region name for each part on one of five chromosomes."""
    p = F.col("p_partkey")
    name = F.concat(F.lit("chr"), (p % 5 + 1).cast("string"), F.lit(sep[0]), start.cast("string"), F.lit(sep[1]), (start + 50).cast("string"))
    return read_table(spark, folder, "part").select(p.alias("part"), name.alias("peak"))


def spaced(step: int) -> Column:
    """Starts at regular steps."""
    return F.floor(F.col("p_partkey") / 5) * step + 1


def paired() -> Column:
    """Starts in pairs 1500 apart, a pair a window of 8000."""
    p = F.col("p_partkey")
    return F.floor(p / 10) * 8000 + F.floor(p / 5) % 2 * 1500 + 4100


def chained() -> Column:
    """Starts in threes 1001 apart, three a window of 12000."""
    p = F.col("p_partkey")
    return F.floor(p / 15) * 12000 + F.floor(p / 5) % 3 * 1001 + 7000


def fixture(spark: SparkSession, folder: str, start: Column) -> tuple[DataFrame, DataFrame, int]:
    """(counts, regions, n_cells) of the lineitem projection with these starts."""
    regions = add_region_infos(part_names(spark, folder, start))
    counts = lineitem_counts(spark, folder).join(regions.select("part", "idx"), "part").select("cell", "idx", "value")
    return counts, regions, read_table(spark, folder, "supplier").count()

"""Overlapping range windows along chromosomes.

Windows lie on two grids, from 0 and from half a window.  A region belongs to a window if its start or its end is strictly inside, the last
position excluded.  On a grid this is arithmetic: the window of a position is its quotient, and the remainder tells
whether it is inside; so a region is exploded to at most two windows a grid, and no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["chromosome", "off", "w"]


def chromosome_ends(regions: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """(chromosome, max_end): the largest end, or the given size."""
    out = regions.groupBy("chromosome").agg(F.max("end").alias("max_end"))
    if sizes:
        given = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])
        out = out.withColumn("max_end", F.coalesce(given[F.col("chromosome")].cast("bigint"), "max_end"))
    return out


def window_grid(regions: DataFrame, window_size: int, sizes: dict[str, int] | None = None) -> DataFrame:
    """(chromosome, off, w, ws): all windows of both grids; off is 0 or 1, ws the start."""
    ends = chromosome_ends(regions, sizes).withColumn("off", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.col("off") * (window_size // 2)
    last = F.floor((F.col("max_end") - 1 - first) / window_size)
    some = ends.where(first < F.col("max_end"))
    return some.select("chromosome", "off", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("w")).withColumn("ws", F.col("off") * (window_size // 2) + F.col("w") * window_size)


def _window_of(x: Column, first: Column, window_size: int, max_end: Column) -> Column:
    """Number of the window that has the position inside, or null."""
    rest = F.pmod(x - first, F.lit(window_size))
    w = F.floor((x - first) / window_size)
    return F.when((rest >= 1) & (rest <= window_size - 2) & (w >= 0) & (first + w * window_size < max_end), w)


def window_members(regions: DataFrame, window_size: int, sizes: dict[str, int] | None = None) -> DataFrame:
    """The regions' columns with off and w of each window that they belong to."""
    columns = regions.columns
    ends = chromosome_ends(regions, sizes)
    both = regions.join(F.broadcast(ends), "chromosome").withColumn("off", F.explode(F.array(F.lit(0), F.lit(1))))  # a row a chromosome
    first = F.col("off") * (window_size // 2)
    found = F.array_distinct(F.array_compact(F.array(*[_window_of(F.col(c), first, window_size, F.col("max_end")) for c in ("start", "end")])))
    return both.withColumn("w", F.explode(found)).select(*columns, "off", "w")


def window_sizes(members: DataFrame) -> DataFrame:
    """Members and span of centres of each window."""
    mid = (F.col("start") + F.col("end")) / 2
    return members.groupBy(*KEY).agg(F.count("*").alias("n"), (F.max_by(mid, "idx") - F.min_by(mid, "idx")).alias("span"))


def scoring_windows(members: DataFrame, max_elements: int = 200) -> DataFrame:
    """Windows that are scored: of two members to ``max_elements``."""
    return window_sizes(members).where((F.col("n") > 1) & (F.col("n") <= max_elements))


def sampling_windows(members: DataFrame, max_elements: int = 200, distance_constraint: float | None = None) -> DataFrame:
    """Windows that the penalty may be fitted on: fewer than ``max_elements`` members, and centres farther apart than the constraint."""
    some = window_sizes(members).where((F.col("n") > 0) & (F.col("n") < max_elements))
    return some if distance_constraint is None else some.where(F.col("span") > distance_constraint)


def member_pairs(members: DataFrame, strict: bool = True) -> DataFrame:
    """Pairs (i < j, or i <= j) of members of one window, with their coordinates: an equi-join on the window.

    A window has at most as many members as its gate lets through, which bounds the pairs.
    """
    side = lambda s: members.select(*KEY, F.col("idx").alias(s), F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}"))
    return side("i").join(side("j"), KEY).where(F.col("i") < F.col("j") if strict else F.col("i") <= F.col("j"))

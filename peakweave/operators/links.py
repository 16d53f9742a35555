"""Networks: reconciling windows, link lists, statistics of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def coverage(members: DataFrame, windows: DataFrame) -> DataFrame:
    """(idx, windows): the accepted windows of each region, over both grids."""
    kept = members.join(windows.select("chromosome", "off", "w"), ["chromosome", "off", "w"], "left_semi")
    return kept.groupBy("idx").agg(F.array_sort(F.collect_set(F.struct("off", "w"))).alias("windows"))


def reconcile(scores: DataFrame, cover: DataFrame) -> DataFrame:
    """One score a pair from the scores (off, i, j, score) of all windows.

    Sums of the two grids with opposite signs cancel; otherwise the sum is divided by how many accepted windows hold both
    regions, those that scored the pair 0 included.
    """
    s = lambda k: F.sum(F.when(F.col("off") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}")
    sums = scores.groupBy("i", "j").agg(s(0), s(1)).where((F.col("s0") * F.col("s1") >= 0) & (F.col("s0") + F.col("s1") != 0))
    side = lambda k: cover.select(F.col("idx").alias(k), F.col("windows").alias(f"windows_{k}"))
    both = sums.join(side("i"), "i").join(side("j"), "j")
    n = F.size(F.array_intersect("windows_i", "windows_j"))
    return both.select("i", "j", ((F.col("s0") + F.col("s1")) / n).alias("score"))


def extract_links(network: DataFrame, regions: DataFrame, columns: tuple[str, str] = ("Peak1", "Peak2")) -> DataFrame:
    """Named links of the upper triangle (i < j), not yet ordered."""
    names = regions.select("idx", "peak")
    upper = network.where("i < j")
    a = upper.join(names.select(F.col("idx").alias("i"), F.col("peak").alias(columns[0])), "i")
    return a.join(names.select(F.col("idx").alias("j"), F.col("peak").alias(columns[1])), "j").select(*columns, "score", "i", "j")


def order_links(links: DataFrame) -> DataFrame:
    """Largest scores first, ties in the order of regions."""
    return links.orderBy(F.desc("score"), "i", "j").drop("i", "j")


#: Values that the search for an order statistic may bring to the driver, and bins of each pass before.
FEW, BINS = 10_000, 4096


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Exact values at some ranks (from 0): each pass counts values in bins and goes on in the bins that hold the ranks.

    A pass is one aggregate of at most BINS rows, so no task or driver holds the values themselves.
    """
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    out: dict[int, float] = {}
    open_: list[tuple[float | None, float | None, int, list[int]]] = [(None, None, 0, sorted(set(ranks)))]
    while open_:
        low, high, before, wanted = open_.pop()
        part = values if low is None else values.where(F.col("v").between(low, high))
        size = part.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).first()
        if not size.n:
            continue
        if size.a == size.b or size.n <= FEW:
            own = [size.a] * size.n if size.a == size.b and size.n > FEW else sorted(r.v for r in part.collect())
            out |= {k: float(own[k - before]) for k in wanted}
            continue
        step = (size.b - size.a) / BINS
        place = F.least(F.floor((F.col("v") - size.a) / step), F.lit(BINS - 1)) if step else F.lit(0)
        bins = part.groupBy(place.alias("bin")).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).collect()
        done = before
        for r in sorted(bins, key=lambda r: r.a):
            inside = [k for k in wanted if done <= k < done + r.n]
            if inside:
                open_.append((r.a, r.b, done, inside))
            done += r.n
    return out


def score_quantiles(network: DataFrame, at: list[float], score: str = "score") -> DataFrame:
    """(p, value): exact quantiles with linear interpolation."""
    network = checkpointed(network.select(score).where(F.col(score).isNotNull()))
    n = network.count()
    place = {p: p * (n - 1) for p in at} if n else {}
    found = order_statistics(network, score, [k for x in place.values() for k in (int(x), min(int(x) + 1, n - 1))])
    rows = [(p, found[int(x)] + (found[min(int(x) + 1, n - 1)] - found[int(x)]) * (x - int(x))) for p, x in place.items()]
    return network.sparkSession.createDataFrame(rows, "p double, value double")


def score_histogram(network: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): scores in equal bins from ``low`` to ``high``; bin 0 is below, bins + 1 is from ``high`` on."""
    b = F.width_bucket("score", F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return network.groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def top_links(links: DataFrame, k: int) -> DataFrame:
    """The k largest scores by chromosome of the first region's name."""
    chromosome = F.split("Peak1", "_").getItem(0)
    rank = F.row_number().over(Window.partitionBy("chromosome").orderBy(F.desc("score"), "i", "j"))
    return links.withColumn("chromosome", chromosome).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def symmetric(upper: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Both triangles of a network given by one of them, and a diagonal of ones for the regions if they are given."""
    own, mirror = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(F.array(own, mirror))
    out = upper.select(F.explode(both).alias("at"), "score").select("at.i", "at.j", "score")
    return out if regions is None else out.unionByName(regions.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("score")))

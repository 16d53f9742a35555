"""Modules of a network: threshold graph, communities, cutoff search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.louvain import louvain
from .lineage import checkpointed


def ccan_edges(links: DataFrame, cutoff: float, a: str = "Peak1", b: str = "Peak2", score: str = "score") -> DataFrame:
    """Undirected edges (a, b, w) above the cutoff, and a loop of weight 0 at each of their nodes."""
    above = links.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) > cutoff))
    order = F.col("ord" if "ord" in links.columns else score)
    row = lambda x, y, loop: F.struct(x.alias("a"), y.alias("b"), F.lit(loop).alias("loop"))
    rows = F.array(row(F.least(a, b), F.greatest(a, b), False), row(F.col(a), F.col(a), True), row(F.col(b), F.col(b), True))
    # links, which may be long to find, are read once for their edges and both their nodes
    flat = above.select(F.explode(rows).alias("at"), F.col(score).alias("w"), order.alias("order")).select("at.*", "w", "order")
    last = F.when(F.col("loop"), 0.0).otherwise(F.max_by("w", "order"))
    return flat.groupBy("a", "b", "loop").agg(last.alias("w")).drop("loop")


def ccan_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From a task's edges (a, b): each node with the smallest one that these edges reach."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for frame in frames:
        for a, b in zip(frame["a"], frame["b"], strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = sorted(root)
    yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]}, dtype=object)


def component_labels(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable.

    Edges are dealt out by ranges of names, as near regions are linked, and each task's are replaced by stars.  Stars that share a node
    link their smallest nodes; only those are settled by rounds of min labels with pointer jumping, the others keep their star's.
    """
    stars = edges.select("a", "b").repartitionByRange("a").mapInPandas(_stars, "a string, b string")
    # a node has a root in a task at most, so its roots are no more than tasks
    roots = stars.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("roots"))
    placed = checkpointed(roots.select(F.col("a").alias("node"), F.col("roots").getItem(0).alias("root"), F.when(F.size("roots") > 1, F.col("roots")).alias("several")))
    links = placed.where("several IS NOT NULL").select(F.col("root").alias("a"), F.explode("several").alias("b")).where("a <> b")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(links.select(F.explode(ways).alias("at")).select("at.*").distinct())
    if not both.limit(1).count():
        return placed.select("node", F.col("root").alias("component"))
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = checkpointed(step.join(jump, F.col("label") == F.col("n2"), "left").select("node", F.least("label", F.coalesce("l2", "label")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            settled = labels.select(F.col("node").alias("root"), "label")
            return placed.join(settled, "root", "left").select("node", F.coalesce("label", "root").alias("component"))
    raise RuntimeError("components did not settle")


def communities(edges: DataFrame, seed: int = 42) -> DataFrame:
    """(node, community): Louvain in each component with the whole graph's weight; a community is named by its smallest node."""
    edges = checkpointed(edges)
    total = float(edges.agg(F.sum("w")).first()[0] or 0.0)
    labels = component_labels(edges)
    placed = edges.join(labels.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "w")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(zip(*[frame[c] for c in ("component", "a", "b", "w")], strict=True) for frame in frames)
        nodes: list[str] = []
        names: list[str] = []
        for _, own in groupby(rows, itemgetter(0)):
            part = [r[1:] for r in own]
            found = louvain(list({v for a, b, _ in part for v in (a, b)}), part, seed, total)
            first: dict[int, str] = {}
            for v in sorted(found):
                first.setdefault(found[v], v)
            nodes += found
            names += [first[c] for c in found.values()]
            if len(nodes) >= 10_000:
                yield pd.DataFrame({"node": nodes, "community": names})
                nodes, names = [], []
        yield pd.DataFrame({"node": nodes, "community": names}, dtype=object)

    # sorted, so that a task solves many small components from a few batches; solving is long and its rows are few bytes, so tasks are not merged
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "component").sortWithinPartitions("component", "a", "b").mapInPandas(solve, "node string, community string")


def modules(found: DataFrame, smallest: int = 3) -> DataFrame:
    """(node, community) of the communities with at least so many nodes."""
    sizes = found.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= smallest)
    return found.join(sizes.select("community"), "community", "left_semi")


def number_of_ccans(links: DataFrame, cutoff: float, seed: int = 42, **columns: str) -> int:
    return communities(ccan_edges(links, cutoff, **columns), seed).groupBy("community").count().where(F.col("count") >= 3).count()


def find_ccan_cutoff(links: DataFrame, tolerance_digits: int = 2, seed: int = 42, a: str = "Peak1", b: str = "Peak2", score: str = "score") -> float:
    """The cutoff with the most modules, by bisection on [0, 1] that steps up until the number changes."""
    positive = checkpointed(links.where(F.col(score) > 0))
    known: dict[float, int] = {}

    def count(t: float) -> int:
        if t not in known:
            known[t] = number_of_ccans(positive, t, seed, a=a, b=b, score=score)
        return known[t]

    low, high = 0.0, 1.0
    while high - low > 10**-tolerance_digits:
        t = low + round((high - low) / 2, tolerance_digits + 1)
        n = more = count(t)
        step, up = (high - low) / 10, t
        while n and more == n and up < 1:
            up += step
            more = count(up)
        if n == 0 or n > more:
            high = t
        else:
            low = t
    return round((low + high) / 2, tolerance_digits)


def find_ccans(links: DataFrame, peak1_col: str = "Peak1", peak2_col: str = "Peak2", score_col: str = "score", coaccess_cutoff_override: float | None = None, tolerance_digits: int = 2, seed: int = 42) -> DataFrame:
    """(Peak, CCAN) of the regions in modules of three or more; numbers go by each module's smallest region."""
    for c in (peak1_col, peak2_col, score_col):
        if c not in links.columns:
            raise AssertionError(f"no column {c}")
    if coaccess_cutoff_override is not None and not 0 <= coaccess_cutoff_override <= 1:
        raise AssertionError("coaccess_cutoff_override must be in [0, 1]")
    cutoff = coaccess_cutoff_override
    if cutoff is None:
        cutoff = find_ccan_cutoff(links, tolerance_digits, seed, peak1_col, peak2_col, score_col)
    found = checkpointed(modules(checkpointed(communities(ccan_edges(links, cutoff, peak1_col, peak2_col, score_col), seed))))
    spark: SparkSession = links.sparkSession
    names = found.select("community").distinct().orderBy("community").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    numbered = spark.createDataFrame(names, "community string, number bigint")
    return found.join(numbered, "community").select(F.col("node").alias("Peak"), F.col("number").cast("int").alias("CCAN"))


def add_ccans(regions: DataFrame, ccans: DataFrame, ccan_col: str = "CCAN") -> DataFrame:
    """Regions with their module, null where they have none; joined by name."""
    return regions.join(ccans.select(F.col("Peak").alias("peak"), F.col("CCAN").alias(ccan_col)), "peak", "left")


def ccan_sizes(ccans: DataFrame, smallest: int = 3) -> DataFrame:
    return ccans.groupBy("CCAN").agg(F.count("*").alias("n")).where(F.col("n") >= smallest)

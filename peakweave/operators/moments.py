"""Sums, covariances, correlations and ranks of counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import correlation, sample_covariance
from .windows import KEY

RIDGE = 1e-4


def observed_cells(members: DataFrame, counts: DataFrame) -> DataFrame:
    """Cells with a count in each window; the others are rows of zeros."""
    return members.join(counts, "idx").groupBy(*KEY).agg(F.countDistinct("cell").alias("n_nonnull"))


#: Regions of a block, in their order: near regions are paired, so that most counts are needed in one block only.
BLOCK = 256


class _Block:
    """A block's pairs and what their counts have added up to."""

    def __init__(self, i: np.ndarray, j: np.ndarray) -> None:
        order = np.argsort(i, kind="stable")
        self.i, self.j = i[order], j[order]
        self.own = np.unique(np.concatenate([i, j]))
        self.first = np.searchsorted(self.i, self.own)
        self.degree = np.searchsorted(self.i, self.own, "right") - self.first
        self.partner = np.searchsorted(self.own, self.j)
        self.sxy, self.sx, self.sxx = np.zeros(len(i)), np.zeros(len(self.own)), np.zeros(len(self.own))

    def add_sums(self, idx: np.ndarray, value: np.ndarray) -> None:
        at = np.searchsorted(self.own, idx)
        self.sx += np.bincount(at, value, len(self.own))
        self.sxx += np.bincount(at, value * value, len(self.own))

    def add_products(self, cell: np.ndarray, idx: np.ndarray, value: np.ndarray, most: int = 1 << 20) -> None:
        """Products of whole cells, whose rows are sorted by cell and region; about ``most`` are looked for at once."""
        new = np.concatenate([[True], cell[1:] != cell[:-1]])
        place = (np.cumsum(new) - 1) * len(self.own) + np.searchsorted(self.own, idx)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        place, value = place[first], np.add.reduceat(value, first)
        at = place % len(self.own)
        degree = self.degree[at]
        before = np.cumsum(degree) - degree
        for k in range(0, int(degree.sum()), most):
            a, b = np.searchsorted(before, [k, k + most])
            n = degree[a:b]
            row = np.repeat(np.arange(a, b), n)
            pair = self.first[at[row]] + np.arange(len(row)) - np.repeat(before[a:b] - before[a] if b > a else n, n)
            wanted = place[row] - at[row] + self.partner[pair]
            found = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            hit = place[found] == wanted
            self.sxy += np.bincount(pair[hit], value[row[hit]] * value[found[hit]], len(self.sxy))

    def rows(self) -> pa.RecordBatch:
        a, b = np.searchsorted(self.own, self.i), self.partner
        columns = [self.i, self.j, self.sxy, self.sx[a], self.sxx[a], self.sx[b], self.sxx[b]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["i", "j", "sxy", "s_i", "q_i", "s_j", "q_j"])


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block's pairs, from its pairs (kind 0), counts without a cell (1) and counts (2) sorted by cell and region.

    Held are a block's pairs and a batch with the last cell before it, not the block's counts.
    """
    at, pairs, block, held = None, [], None, None

    def close(block: _Block | None, held: tuple | None) -> Iterator[pa.RecordBatch]:
        block = block or (_Block(*map(np.concatenate, zip(*pairs, strict=True))) if pairs else None)
        if block and held:
            block.add_products(*held)
        if block:
            yield block.rows()

    for batch in batches:
        number, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True):
            if a == b:
                continue
            if number[a] != at:
                yield from close(block, held)
                at, pairs, block, held = number[a], [], None, None
            part = batch.slice(a, b - a)
            idx = part.column("idx").to_numpy()
            if kind[a] == 0:
                pairs.append((idx, part.column("j").to_numpy()))
                continue
            block = block or _Block(*map(np.concatenate, zip(*pairs, strict=True)))
            value = part.column("value").to_numpy()
            block.add_sums(idx, value)
            if kind[a] == 2:
                rows = (part.column("cell").to_numpy(zero_copy_only=False), idx, value)
                rows = tuple(map(np.concatenate, zip(held, rows, strict=True))) if held else rows
                new = np.flatnonzero(rows[0][1:] != rows[0][:-1])
                last = int(new[-1]) + 1 if len(new) else 0  # the last cell may go on
                if last:
                    block.add_products(*[x[:last] for x in rows])
                held = tuple(x[last:] for x in rows)
    yield from close(block, held)


def pair_sums(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(i, j, sxy, s_i, q_i, s_j, q_j) of each distinct pair: sums of products, of counts and of their squares; 0 where there are none.

    Pairs are dealt to blocks by their first region; counts go to the blocks that need them and are multiplied there, cell by cell, so
    that counts are shuffled by region and by block, and products not at all.
    """
    some = pairs.select("i", "j").distinct().withColumn("block", F.floor(F.col("i") / BLOCK))
    need = some.select("block", F.explode(F.array("i", "j")).alias("idx")).distinct()
    own = counts.where("value IS NOT NULL").select("idx", "cell", F.col("value").cast("double"))
    values = need.join(own, "idx").select("block", F.when(F.col("cell").isNull(), 1).otherwise(2).alias("kind"), "cell", "idx", F.lit(None).cast("bigint").alias("j"), "value")
    nothing = F.lit(None).cast(counts.schema["cell"].dataType)
    links = some.select("block", F.lit(0).alias("kind"), nothing.alias("cell"), F.col("i").alias("idx"), "j", F.lit(0.0).alias("value"))
    dealt = links.unionByName(values).repartition("block").sortWithinPartitions("block", "kind", "cell", "idx")
    return dealt.mapInArrow(_block_sums, "i bigint, j bigint, sxy double, s_i double, q_i double, s_j double, q_j double")


def pair_moments(pairs: DataFrame, counts: DataFrame, n_cells: int) -> DataFrame:
    """(i, j, cov, var_i, var_j) over all cells, absent counts being zeros."""
    cov = lambda q, a, b: sample_covariance(n_cells, F.col(q), F.col(a), F.col(b))
    return pair_sums(pairs, counts).select("i", "j", cov("sxy", "s_i", "s_j").alias("cov"), cov("q_i", "s_i", "s_i").alias("var_i"), cov("q_j", "s_j", "s_j").alias("var_j"))


def pair_correlations(moments: DataFrame) -> DataFrame:
    return moments.withColumn("corr", F.when(F.col("i") == F.col("j"), 1.0).otherwise(correlation(F.col("cov"), F.col("var_i"), F.col("var_j"))))


def ridge(moments: DataFrame, by: float = RIDGE) -> DataFrame:
    """Covariances with a small ridge on the diagonal."""
    return moments.withColumn("cov", F.when(F.col("i") == F.col("j"), F.col("cov") + by).otherwise(F.col("cov")))


def average_ranks(counts: DataFrame, n_cells: int, winsorize: bool = False, truncation: float | None = None, features: int = 1) -> DataFrame:
    """(cell, idx, rank, zero_rank): average ranks over all cells, divided by their number; of counts, and of each region's absent ones.

    Absent counts are zeros and are never made: negative counts come before them, positive ones after.  Winsorized ranks are shrunk
    (more than 100 cells a region) or clipped.
    """
    w = Window.partitionBy("idx")
    own = counts.where("value <> 0")
    ties = F.count("*").over(w.orderBy("value").rangeBetween(Window.currentRow, Window.currentRow))  # of the one order that all need
    zeros = F.lit(n_cells) - F.count("*").over(w)
    below = F.count_if(F.col("value") < 0).over(w)
    low = F.rank().over(w.orderBy("value")) + F.when(F.col("value") > 0, zeros).otherwise(0)
    rank, zero = (low + (ties - 1) / 2) / n_cells, (below + (zeros + 1) / 2) / n_cells
    if winsorize:
        if truncation is not None and truncation > 1:
            raise TypeError("truncation must be 1 at most")
        t = truncation if truncation is not None else 1 / (4 * n_cells**0.25 * math.sqrt(math.pi * math.log(n_cells)))
        bound = (lambda r: n_cells * r / (n_cells + 1)) if n_cells > 100 * features else lambda r: F.least(F.greatest(r, F.lit(t)), F.lit(1 - t))
        rank, zero = bound(rank), bound(zero)
    return own.select("cell", "idx", rank.alias("rank"), zero.alias("zero_rank"))


def pair_kendall(pairs: DataFrame, counts: DataFrame, n_cells: int) -> DataFrame:
    """(i, j, tau): tau-b of pairs over all cells.

    Cells with equal counts in both regions are one row with their number, and so are the cells that have neither; rows of a pair are then
    compared.  A pair has as many rows as its regions have different counts together, not as there are cells.
    """
    some = pairs.select("i", "j").distinct()
    own = counts.where("value <> 0").select("cell", "idx", "value")
    x = some.join(own.withColumnsRenamed({"idx": "i", "value": "x"}), "i")
    y = some.join(own.withColumnsRenamed({"idx": "j", "value": "y"}), "j")
    seen = x.join(y, ["i", "j", "cell"], "full").groupBy("i", "j", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")).agg(F.count("*").alias("n"))
    rest = some.join(seen.groupBy("i", "j").agg(F.sum("n").alias("m")), ["i", "j"], "left")
    none = rest.select("i", "j", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.lit(n_cells) - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
    rows = seen.unionByName(none)
    a, b = rows.withColumnsRenamed({"x": "x1", "y": "y1", "n": "n1"}), rows.withColumnsRenamed({"x": "x2", "y": "y2", "n": "n2"})
    dx, dy, n = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2")), F.col("n1") * F.col("n2")
    tau = F.sum(dx * dy * n) / F.sqrt(F.sum(F.abs(dx) * n) * F.sum(F.abs(dy) * n))
    return a.join(b, ["i", "j"]).groupBy("i", "j").agg(tau.alias("tau"))


def pair_coefficients(pairs: DataFrame, counts: DataFrame, n_cells: int, method: str = "corrcoef") -> DataFrame:
    """(i, j, value): initial coefficients of pairs i < j: corrcoef, cov, spearman or kendalltau over all cells."""
    if method == "cov":
        return pair_moments(pairs, counts, n_cells).select("i", "j", F.col("cov").alias("value"))
    if method == "corrcoef":
        return pair_correlations(pair_moments(pairs, counts, n_cells)).select("i", "j", F.col("corr").alias("value"))
    if method == "spearman":  # ranks less the rank of absent counts: these are then zeros, and covariances do not change
        shifted = average_ranks(counts, n_cells).select("cell", "idx", (F.col("rank") - F.col("zero_rank")).alias("value"))
        rho = pair_correlations(pair_moments(pairs, shifted, n_cells))
        return rho.select("i", "j", (2 * F.sin(F.col("corr") * math.pi / 6)).alias("value"))
    if method == "kendalltau":
        return pair_kendall(pairs, counts, n_cells).select("i", "j", F.sin(F.col("tau") * math.pi / 2).alias("value"))
    raise ValueError(f"unknown method {method!r}: corrcoef, cov, spearman or kendalltau")


def frobenius_error(moments: DataFrame, estimate: Column) -> DataFrame:
    """(error): Frobenius norm, above the diagonal, of covariances less an estimate of theirs."""
    gap = F.col("cov") - estimate
    return moments.where("i < j").agg(F.sqrt(F.sum(gap * gap)).alias("error"))

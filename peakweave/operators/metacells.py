"""Metacells: normalisation, embedding, neighbours, selection and aggregates of similar cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed
from .preprocess import empty_regions

#: Embedding rows that are broadcast at once in the neighbour search.
BLOCK_ROWS = 20_000


def tfidf(counts: DataFrame, n_cells: int) -> DataFrame:
    """Value over the cell's sum, times cells over the region's sum (no logarithm)."""
    rows = counts.groupBy("cell").agg(F.sum("value").alias("row"))
    columns = counts.groupBy("idx").agg(F.sum("value").alias("column"))
    both = counts.join(rows, "cell").join(columns, "idx")
    return both.select("cell", "idx", (F.col("value") / F.col("row") * (F.lit(float(n_cells)) / F.col("column"))).alias("value"))


def lsi_normalize(counts: DataFrame, n_cells: int) -> DataFrame:
    """tf-idf, each cell scaled to a sum of 1, then log1p of 10,000 times that."""
    x = tfidf(counts, n_cells)
    total = x.groupBy("cell").agg(F.sum(F.abs("value")).alias("total"))
    return x.join(total, "cell").select("cell", "idx", F.log1p(F.col("value") / F.col("total") * 1e4).alias("value"))


def _flat(batch: pa.RecordBatch, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the entries of a batch of sparse rows (at, value); places are those of ``at`` in the sorted ids."""
    at = batch.column("at")
    row = np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy(zero_copy_only=False))
    return row, np.searchsorted(ids, at.flatten().to_numpy()), batch.column("value").flatten().to_numpy()


def _times(to: np.ndarray, at: np.ndarray, value: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """n rows: at ``to`` the sums of value * q[at]."""
    return np.stack([np.bincount(to, value * c[at], n) for c in np.ascontiguousarray(q.T)], 1)


def lsi(counts: DataFrame, n_cells: int, n_components: int = 20, highly_variable: DataFrame | None = None, seed: int = 0, rounds: int = 7, oversample: int = 10) -> DataFrame:
    """(cell, vec): left singular vectors of the normalised counts, standardised within each cell.

    Randomised subspace iteration: the matrix stays distributed, in rows of its larger side (cells or regions), and only sums of
    (smaller side x components) meet in the driver.  Of each component the entry with the largest absolute value is made positive.
    """
    own = counts if highly_variable is None else counts.join(highly_variable.select("idx"), "idx", "left_semi")
    spark = counts.sparkSession
    x = checkpointed(lsi_normalize(own, n_cells))
    n_rows, n_columns = (x.select(c).distinct().count() for c in ("cell", "idx"))
    near, far = ("cell", "idx") if n_rows < n_columns else ("idx", "cell")
    ids = np.sort(x.select(F.col(near).cast("bigint")).distinct().toArrow().column(0).to_numpy())
    k = min(n_components + oversample, n_rows, n_columns)
    sorted_row = F.array_sort(F.collect_list(F.struct(near, "value")))
    by_far = checkpointed(x.groupBy(far).agg(sorted_row.alias("row")).select(far, F.col(f"row.{near}").cast("array<bigint>").alias("at"), F.col("row.value").alias("value")))
    by_far = by_far.coalesce(max(1, spark.sparkContext.defaultParallelism))  # a task's sums are as many rows as the smaller side has
    basis = np.random.default_rng(seed).normal(size=(len(ids), k))
    names = [f"c{i}" for i in range(k)]
    sums_schema = "r bigint, " + ", ".join(f"{c} double" for c in names)

    def summed(parts: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], n: int) -> np.ndarray:
        """The tasks' rows, summed by number, of which there are n."""
        found = by_far.mapInArrow(parts, sums_schema).groupBy("r").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        out = np.zeros((n, k))
        out[found.column("r").to_numpy()] = np.stack([found.column(c).to_numpy() for c in names], 1)
        return out

    def numbered(total: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(total.any(1))
        return pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, i]) for i in range(k)]], ["r", *names])

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((ids, np.linalg.qr(basis)[0]))

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            total = np.zeros((len(own), k))
            for batch in batches:
                row, at, value = _flat(batch, own)
                total += _times(at, row, value, _times(row, at, value, q, len(batch)), len(own))
            yield numbered(total)

        basis = summed(product, len(ids))
        shared.unpersist()
    q = np.linalg.qr(basis)[0]
    shared = spark.sparkContext.broadcast((ids, q))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        total = np.zeros((k, k))
        for batch in batches:
            row, at, value = _flat(batch, own)
            y = _times(row, at, value, q, len(batch))
            total += y.T @ y
        yield numbered(total)

    values, vectors = np.linalg.eigh(summed(squares, k))
    order = np.argsort(values)[::-1][: min(n_components, k)]

    def standard(u: np.ndarray) -> list[np.ndarray]:
        sd = u.std(1, ddof=1, keepdims=True) if u.shape[1] > 1 else np.ones((len(u), 1))
        return list((u - u.mean(1, keepdims=True)) / np.where(sd == 0, 1, sd))

    if near == "cell":  # the vectors are those of the side that is here
        u = q @ vectors[:, order]
        u *= np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
        solved = spark.sparkContext.broadcast((ids, u))

        def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, u = solved.value
            for frame in frames:
                at = frame["id"].to_numpy()
                yield pd.DataFrame({"cell": own[at], "vec": standard(u[at])})

        return spark.range(len(ids)).mapInPandas(listed, "cell bigint, vec array<double>")
    turn = vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-300))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for batch in batches:
            row, at, value = _flat(batch, own)
            y = _times(row, at, value, q, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(list(y), pa.list_(pa.float64()))], ["cell", "y"])

    projected = checkpointed(by_far.mapInArrow(project, "cell bigint, y array<double>"))

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            u = np.stack(frame["y"]) @ turn
            at = np.abs(u).argmax(0)
            yield pd.DataFrame({"c": np.arange(u.shape[1]), "v": u[at, np.arange(u.shape[1])], "cell": frame["cell"].to_numpy()[at]})

    best = projected.mapInPandas(ends, "c bigint, v double, cell bigint").groupBy("c").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("cell"))).alias("v")).toPandas().sort_values("c")
    turn = turn * np.where(best["v"].to_numpy() < 0, -1.0, 1.0)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"cell": frame["cell"], "vec": standard(np.stack(frame["y"]) @ turn)})

    return projected.mapInPandas(finish, "cell bigint, vec array<double>")


def knn(embedding: DataFrame, k: int, id_column: str = "cell", vec: str = "vec") -> DataFrame:
    """(cell, neighbor, rank): the k nearest by Euclidean distance, the cell itself included; ties by id.

    The table is searched in blocks of BLOCK_ROWS rows, each broadcast in turn; every row keeps its k best of each block.
    """
    points = checkpointed(embedding.select(F.col(id_column).alias("cell"), F.col(vec).cast("array<double>").alias("vec")))
    n = points.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    spark, found = embedding.sparkSession, None
    for b in range(blocks):
        own = (points if blocks == 1 else points.where(F.pmod(F.xxhash64("cell"), F.lit(blocks)) == b)).toPandas().sort_values("cell")
        if not len(own):
            continue
        shared = spark.sparkContext.broadcast((own["cell"].to_numpy(), np.stack(own["vec"])))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, base = shared.value
            keep, norm = min(k, len(ids)), (base * base).sum(1)
            most = norm.max()
            for frame in frames:
                for i in range(0, len(frame), 256):
                    part = frame.iloc[i : i + 256]
                    q = np.stack(part["vec"])
                    # one matrix product finds who may be among the nearest, with room for its rounding; their distances are then exact
                    size = (q * q).sum(1)[:, None]
                    near = size + norm - 2 * (q @ base.T)
                    cut = np.partition(near, keep - 1, axis=1)[:, keep - 1 : keep]
                    row, col = np.nonzero(near <= cut + 1e-9 * (size + most))  # ties at the border are settled by id below
                    d = ((base[col] - q[row]) ** 2).sum(1)
                    yield pd.DataFrame({"cell": part["cell"].to_numpy()[row], "neighbor": ids[col], "d": d})

        part = points.mapInPandas(search, "cell bigint, neighbor bigint, d double")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("cell").orderBy("d", "neighbor"))
    return found.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= k).select("cell", "neighbor", "rank")


def conflicts(sets: DataFrame, k: int, least: int) -> DataFrame:
    """(a, b), a < b: sets (cell, members) of k members that share ``least`` or more.

    Members are ordered by how many sets have them, rarest first; sets that share ``least`` members share one of the
    first k - least + 1, so only those are joined, and the pairs found are compared whole.
    """
    flat = sets.select("cell", F.explode("members").alias("m"))
    often = flat.groupBy("m").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("often", "m"))
    first = checkpointed(flat.join(often, "m").withColumn("place", place).where(F.col("place") <= max(1, k - least + 1)).select("cell", "m"))
    pairs = first.withColumnRenamed("cell", "a").join(first.withColumnRenamed("cell", "b"), "m").where("a < b").select("a", "b").distinct()
    side = lambda c: sets.select(F.col("cell").alias(c), F.col("members").alias(f"members_{c}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")
    return whole.where(F.size(F.array_intersect("members_a", "members_b")) >= least).select("a", "b")


def select_metacells(neighbors: DataFrame, k: int, max_overlap: float = 0.9, max_metacells: int | None = None) -> DataFrame:
    """(metacell, cell): neighbour sets in the order of cells, each accepted if it shares fewer than max_overlap * k cells with every accepted one.

    Only the first ``max_metacells`` sets are looked at.  The greedy choice is the first independent set, in order, of the graph of
    conflicts: in rounds, a set without an undecided earlier conflict is accepted and those in conflict with it go.
    """
    sets = neighbors.groupBy("cell").agg(F.sort_array(F.collect_set("neighbor")).alias("members"))
    if max_metacells is not None:
        sets = sets.orderBy("cell").limit(max(1, max_metacells))
    sets = checkpointed(sets)
    least = math.ceil(max_overlap * k - 1e-9)
    if least <= 0:  # every set is in conflict with the first
        accepted = sets.agg(F.min("cell").alias("cell"))
    else:
        edges = checkpointed(conflicts(sets, k, least))
        accepted, left = sets.select("cell").limit(0), sets.select("cell")
        while True:
            blocked = edges.select(F.col("b").alias("cell")).distinct()
            new = checkpointed(left.join(blocked, "cell", "left_anti"))
            accepted = accepted.unionByName(new)
            gone = edges.join(new.withColumnRenamed("cell", "a"), "a", "left_semi").select(F.col("b").alias("cell")).distinct()
            left = checkpointed(left.join(new, "cell", "left_anti").join(gone, "cell", "left_anti"))
            if not left.limit(1).count():
                break
            keep = lambda e, c: e.join(left.withColumnRenamed("cell", c), c, "left_semi")
            edges = checkpointed(keep(keep(edges, "a"), "b"))
    numbers = accepted.orderBy("cell").rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    numbered = neighbors.sparkSession.createDataFrame(numbers, "metacell bigint, cell bigint")
    return numbered.join(sets, "cell").select("metacell", F.explode("members").alias("cell"))


def aggregate_metacells(counts: DataFrame, members: DataFrame, method: str = "mean") -> DataFrame:
    """(cell, idx, value) with metacells as cells: sum, or mean over all members, those without the region included."""
    if method not in ("mean", "sum"):
        raise ValueError(f"unknown method {method!r}: mean or sum")
    sizes = members.groupBy("metacell").agg(F.count("*").alias("k"))  # joined to the members, as the totals are many more rows
    total = members.join(sizes, "metacell").join(counts, "cell").groupBy("metacell", "idx")
    value = F.sum("value") / F.max("k") if method == "mean" else F.sum("value")
    return total.agg(value.alias("value")).withColumnRenamed("metacell", "cell")


def overlaps(members: DataFrame) -> DataFrame:
    """(a, b, n): cells that two metacells share."""
    side = lambda s: members.select("cell", F.col("metacell").alias(s))
    return side("a").join(side("b"), "cell").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def compute_metacells(counts: DataFrame, regions: DataFrame, n_cells: int, k: int = 50, max_overlap_metacells: float = 0.9, max_metacells: int | None = None, dim_reduction: str = "lsi", projection: str | None = None, method: str = "mean", embedding: DataFrame | None = None) -> DataFrame:
    """Metacell counts from an LSI embedding or a given one (cell, vec)."""
    if empty_regions(counts, regions).limit(1).count():
        raise ValueError("empty regions: filter regions without counts first")
    if projection is not None:
        raise ValueError("only projection=None is supported; pass an embedding")
    if embedding is None:
        if dim_reduction != "lsi":
            raise ValueError(f"unknown dim_reduction {dim_reduction!r}: lsi, or pass an embedding")
        embedding = lsi(counts, n_cells)
    return aggregate_metacells(counts, select_metacells(knn(embedding, k), k, max_overlap_metacells, max_metacells), method)

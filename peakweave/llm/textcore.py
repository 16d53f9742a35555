"""Byte-level text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  A ``Block`` lays some whole texts end to end in one
numpy byte array, so that words, hashes and positions of many documents are found by a few
vector operations.  Blocks are cut at document boundaries, never inside a text; a block holds
about ``BLOCK_BYTES`` or one longer document, which bounds the memory of a task.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_S33 = U64(33)

#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def byte_codes(seed: int, keep: np.ndarray | None = None) -> np.ndarray:
    """A random 64-bit code for each byte value; 0 for the values outside ``keep``."""
    codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    if keep is not None:
        codes = np.where(keep, codes, U64(0))
    return codes


class Powers:
    """Powers of BASE and of its inverse, extended on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = -(-n >> 18 << 18) if n > 1 << 18 else 1 << 18
            up, down = np.full(m, BASE, U64), np.full(m, INVERSE, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down

    def shrink(self, most: int = 1 << 18) -> None:
        """Forget a long text's powers."""
        if len(self.up) > most:
            self.up, self.down = self.up[:most].copy(), self.down[:most].copy()


POWERS = Powers()
#: Bytes whose hash terms are held at once.
PIECE = 1 << 18

#: Word bytes of the licence and benchmark operators, after lower-casing A-Z: 0-9, a-z and all of 0x80 and above.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Word bytes of the quality and fingerprint operators: everything but ASCII white space.
GRAPH = np.ones(256, bool)
GRAPH[0x09:0x0E] = GRAPH[0x20] = False
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Block:
    """Some whole texts end to end: ``data`` bytes, text i at ``bounds[i]:bounds[i + 1]``."""

    __slots__ = ("bounds", "data", "first")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int) -> None:
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lower(self) -> Block:
        return Block(LOWER[self.data], self.bounds, self.first)

    def words(self, table: np.ndarray) -> Words:
        return Words(self, table)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, "right") - 1


class Words:
    """Maximal runs of the bytes in ``table``, never across texts: starts, ends and the first word of each text."""

    __slots__ = ("block", "ends", "first", "starts", "table")

    def __init__(self, block: Block, table: np.ndarray) -> None:
        inside = table[block.data]
        edge = np.empty(len(inside) + 1, bool)
        edge[0], edge[-1] = inside[:1].any(), inside[-1:].any()
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        # a text boundary inside a run ends one word and starts another
        cut = block.bounds[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(inside))])
        cut = cut[inside[cut] & inside[cut - 1]]
        at = np.flatnonzero(edge)
        starts, ends = at[0::2], at[1::2]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        self.block, self.table, self.starts, self.ends = block, table, starts, ends
        self.first = np.searchsorted(starts, block.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 7) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, U64)
        return hashed_spans(self.block.data, self.starts, self.table, seed)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.block)), self.counts())


_CODES: dict[tuple, np.ndarray] = {}


def hashed_spans(data: np.ndarray, starts: np.ndarray, table: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the word bytes from each start up to the next one, PIECE bytes at a time however long a word is."""
    key = (seed, table.tobytes())
    if key not in _CODES:
        _CODES[key] = byte_codes(seed, table)
    codes = _CODES[key]
    up, down = POWERS.upto(PIECE)
    out = np.empty(len(starts), U64)
    ends = np.append(starts[1:], len(data))
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + PIECE, "right"))
        if j > i:
            values = codes[data[lo : ends[j - 1]]]
            values *= up[: len(values)]
            own = starts[i:j] - lo
            out[i:j] = np.add.reduceat(values, own) * down[own]
        else:  # one word longer than a piece
            j, total = i + 1, 0
            for at in range(lo, int(ends[i]), PIECE):
                values = codes[data[at : min(at + PIECE, int(ends[i]))]]
                total += int((values * up[: len(values)]).sum()) * pow(BASE, at - lo, 1 << 64)
            out[i] = total & ((1 << 64) - 1)
        i = j
    return mix64(out)


def blocks(column: pa.Array | pa.ChunkedArray, size: int = 0) -> Iterator[Block]:
    """Cut a string column into blocks; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    size, i = size or BLOCK_BYTES, 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def per_block(work: Callable[[Block, pa.RecordBatch], pa.RecordBatch | None], column: str = "text", size: int = 0):
    """A mapInArrow function that applies ``work`` to each block and the batch's rows for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for block in blocks(batch.column(at), size):
                out = work(block, batch.slice(block.first, len(block)))
                if out is not None and out.num_rows:
                    yield out
        trim()

    return run


def trimmed(work: Callable) -> Callable:
    """A mapInArrow function that gives memory back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return run


def trim() -> None:
    """At a task's end: give a worker's freed memory back, as idle workers stay beside the next ones."""
    POWERS.shrink()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir; where that is unset and Spark runs in one process, one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/peakweave"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
        delete_at_exit(spark, context.getCheckpointDir())
    return folder


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the folder deleted when the application ends, however it does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


#: Rows in a partition of a written table whose rows are known to be few and small.
PART_ROWS = 1 << 16


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute once and cut the lineage by a reliable checkpoint in the shared folder.

    Of a table with about so many small ``rows`` no more files are written than they need, as each costs its executor several
    processes and the file system an entry.
    """
    scratch(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PART_ROWS)))
    return df.checkpoint(eager=True)


#: A key with more than one in so many rows is joined without a shuffle of its rows.
WIDE = 1000


def join_wide(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The rows with the columns of ``table``, one row a key, whose ``count`` says how many of the ``total`` rows have the key.

    The keys of more than total / WIDE rows, fewer than WIDE, are sent to the rows; the others meet theirs by a shuffle.  ``count`` is left out.
    """
    often = F.col(count) * WIDE > total
    hot = F.broadcast(table.where(often).drop(count))
    rest = rows.join(F.broadcast(table.where(often).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(~often).drop(count), key))


def components(edges: DataFrame, rounds: int = 60, nodes: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (id, root) with root the smallest id reachable, but for the roots themselves.

    Alternating large-star and small-star steps; both are grouped minima, so that a hub's rows are
    pre-aggregated, and joins with the minima, which a hub's rows take where they are (join_wide).  Every step is checkpointed; the loop ends when a step changes nothing.
    Ids must be orderable.  Nodes without edges are not returned.  ``nodes``, if known, tells how finely to write tables.  ``rounds``
    only ends a loop that would not end by itself: it raises and drops nothing.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = cut(pairs, nodes)
    known, before = pairs.count(), None
    for _ in range(rounds):
        # large star: every neighbour above a node links to the smallest node around it
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        above = both.where("b > a")
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = join_wide(above, low, "a", "n", known).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut(large.where("a <> b").distinct(), known)  # read three times below
        # small star: every neighbour below a node, and the node, link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = join_wide(large, low, "a", "n", known)
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        pairs = cut(small.where("a <> b").distinct(), known)
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if now == before:
            break
        before, known = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it unlike any column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def attach(df: DataFrame, fields: str, compute: Callable[[Block], list], column: str = "text", name: str = "found", size: int = 0) -> tuple[DataFrame, str]:
    """Add one struct column computed from whole texts; returns the frame and the column's name.

    ``fields`` is the struct's DDL, ``compute`` gives one array a field for a block.  A struct under a free
    name keeps the computed values apart from whatever columns the input has.
    """
    from pyspark.sql.types import StructField, StructType

    kind = StructType.fromDDL(fields)
    name = free_name(df, name)
    schema = StructType([*df.schema.fields, StructField(name, kind)])

    def work(block: Block, rows: pa.RecordBatch) -> pa.RecordBatch:
        got = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in compute(block)], names=kind.names)
        return pa.RecordBatch.from_arrays([*rows.columns, got], names=[*rows.schema.names, name])

    return df.mapInArrow(per_block(work, column, size), schema), name


def per_doc_sum(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between the consecutive indexes in ``first``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[first])


def codes_in(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 + the index in the vocabulary, or 0."""
    if not len(vocabulary) or not len(hashes):
        return np.zeros(len(hashes), np.int64)
    # a table of the hashes' top bits tells most other words apart without a search
    shift = np.uint64(64 - 20)
    seen = np.zeros(1 << 20, bool)
    seen[vocabulary >> shift] = True
    out = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(seen[hashes >> shift])
    at = np.searchsorted(vocabulary, hashes[maybe])
    at[at == len(vocabulary)] = 0
    same = vocabulary[at] == hashes[maybe]
    out[maybe[same]] = at[same] + 1
    return out

"""Line deduplication by pairwise alignment.

A window is a line of MIN_WORDS words or more, or a shorter line with as many lines after it, or before it, as give so many words; a text of
fewer words is one window.  Windows are hashed (two 64-bit hashes) and numbered among their equals within the document, so that the k-th of a
window meets the k-th elsewhere.  Of each that several documents have, the earliest document is the owner, and every later document is
paired with the owners of its windows: at most as many pairs as it has windows, and no pairs among copies.
A pair's windows are aligned: neighbouring matches on one diagonal make a block, patience diff finds the longest run of blocks in one order,
and shared blocks that cross the run are moved blocks.  Aligned and moved blocks are deleted from the later document.

Owners lose nothing against all pairs: a window of a document lies in a common block with some earlier document if and only if it lies in
one with the earliest document that has its k-th occurrence, and that document is its owner.

A line between two deleted ones that has no word goes with them.  Documents none of whose worded lines are left are dropped by the
filter form.

Defined cases: null and empty texts have no lines and stay as they are; rows with the same id and text are one
document; of different texts under one id the one with the smaller hash is earlier, a null id is earlier than any other;
lines without a word are never matched; an empty table gives an empty result; columns of any name pass unchanged.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .substrings import ids_repeat, keyed
from .textcore import GRAPH, POWERS, U64, Block, Words, blocks, cut, documents, free_name, mix64, trimmed

MIN_WORDS = 5
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_LENGTH = U64(0xD6E8FEB86659FD93)

WINDOWS = "h1 bigint, h2 bigint, d bigint, t bigint, at int, n int, nth int"
SPANS = "d bigint, t bigint, lines array<int>, moved int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's windows: hashes, first line, lines, and which of its equals."""
    for batch in batches:
        ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for block in blocks(batch.column(2)):
            out = windows_of(block)
            if out is None:
                continue
            doc, h1, h2, at, n, nth = out
            d, t = ids[block.first :][doc], ties[block.first :][doc]
            columns = [h1.view(np.int64), h2.view(np.int64), d, t, at.astype(np.int32), n.astype(np.int32), nth.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in WINDOWS.split(", ")])


def windows_of(block: Block) -> tuple[np.ndarray, ...] | None:
    """Over a block: document, two hashes, first line (worded lines from 0), lines, and which of its equals in the document."""
    lines = Words(block, _LINE)
    if not len(lines):
        return None
    words = Words(block, GRAPH)
    n_words = np.searchsorted(words.starts, lines.ends) - np.searchsorted(words.starts, lines.starts)
    own = n_words > 0
    if not own.any():
        return None
    doc, n_words = lines.doc()[own], n_words[own]
    first = np.searchsorted(doc, np.arange(len(block) + 1))
    begin, end = first[doc], first[doc + 1]
    upto = np.concatenate([[0], np.cumsum(n_words)])
    i = np.arange(len(doc))
    ahead = np.searchsorted(upto, upto[:-1] + MIN_WORDS)  # the least end with enough words
    behind = np.searchsorted(upto, upto[1:] - MIN_WORDS, "right") - 1  # the largest start with enough
    some = upto[end] - upto[begin] >= MIN_WORDS
    forward, backward = some & (ahead <= end), some & (behind >= begin) & (n_words < MIN_WORDS)
    small = ~some & (i == begin)
    lo = np.concatenate([i[forward], behind[backward], i[small]])
    hi = np.concatenate([ahead[forward], i[backward] + 1, end[small]])
    place = np.unique(lo * (len(doc) + 1) + hi)
    lo, hi = place // (len(doc) + 1), place % (len(doc) + 1)
    up, down = POWERS.upto(len(doc) + 1)

    def hashed(seed: int) -> np.ndarray:
        total = np.zeros(len(doc) + 1, U64)
        np.cumsum(lines.hashes(seed)[own] * up[: len(doc)], out=total[1:])
        return mix64((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(U64) * _LENGTH)

    h1, h2, d = hashed(31), hashed(37), doc[lo]
    order = np.lexsort((lo, h2, h1, d))
    d, h1, h2, lo, hi = (x[order] for x in (d, h1, h2, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return d, h1, h2, lo - first[d], hi - lo, nth


def patience(pairs: list[tuple[int, int]]) -> list[int]:
    """Indexes of a longest run of pairs, ascending in the first, whose second ascends too."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[k], last[k] = b, i
        back[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def united(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans, touching ones joined, within each group (numbered from 0): group, start, end."""
    order = np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    step = int(hi.max(initial=0)) + 1
    reach = np.maximum.accumulate(hi + group * step) - group * step  # the furthest end so far; group by group, as a later one starts above
    new = np.ones(len(lo), bool)
    new[1:] = (group[1:] != group[:-1]) | (lo[1:] > reach[:-1])
    return group[new], lo[new], reach[np.append(new[1:], True)]


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Groups of sorted rows that are equal in the columns, numbered from 0."""
    new = np.zeros(len(columns[0]), bool)
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def align(pair: np.ndarray, at: np.ndarray, n: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of pairs (numbered from 0): pair, first line, end, and whether the block is moved.

    A row says that ``n`` lines from ``at`` of the later document equal those from ``other`` of its owner.
    """
    side = at - other
    order = np.lexsort((at, side, pair))
    pair, at, n, side = pair[order], at[order], n[order], side[order]
    line = _numbered(pair, side)
    which, lo, hi = united(line, at, at + n)
    first = np.searchsorted(line, which)
    pair, side = pair[first], side[first]
    moved = np.zeros(len(lo), bool)
    count = np.bincount(pair)
    for p in np.flatnonzero(count > 1).tolist():  # blocks of one pair stand together
        a = int(np.searchsorted(pair, p))
        b = a + int(count[p])
        by = np.argsort(lo[a:b], kind="stable") + a
        keep = patience(list(zip(lo[by].tolist(), (lo[by] - side[by]).tolist(), strict=True)))
        moved[a:b] = True
        moved[by[keep]] = False
    return pair, lo, hi, moved


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From shared windows sorted by later document and owner: the spans of lines to delete."""
    held: list[np.ndarray] | None = None

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        d, t, od, ot, at, n, other = cols
        document = _numbered(d, t)
        pair, lo, hi, moved = align(_numbered(d, t, od, ot), at.astype(np.int64), n.astype(np.int64), other.astype(np.int64))
        of = document[np.searchsorted(_numbered(d, t, od, ot), pair)]
        doc, start, end = united(of, lo, hi)
        still, a, b = united(of[~moved], lo[~moved], hi[~moved])
        size = int(document[-1]) + 1
        gone = np.bincount(doc, end - start, size) - np.bincount(still, b - a, size)
        place = np.searchsorted(document, np.arange(size))
        ends = np.concatenate([[0], 2 * np.cumsum(np.bincount(doc, minlength=size))]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack([start, end], 1).ravel().astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(d[place]), pa.array(t[place]), spans, pa.array(gone.astype(np.int32))], names=["d", "t", "lines", "moved"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        d, t = cols[0], cols[1]
        last = int(np.flatnonzero((d != d[-1]) | (t != t[-1]))[-1]) + 1 if (d[0], t[0]) != (d[-1], t[-1]) else 0
        if last:
            yield out([x[:last] for x in cols])
        held = [x[last:] for x in cols]  # the last document may go on
    if held is not None and len(held[0]):
        yield out(held)


def common_lines(rows: DataFrame) -> DataFrame:
    """From (d, t, text): the documents that have lines to delete, with the lines' spans.

    Spans are starts and ends in turn, in worded lines from 0; ``moved`` counts the lines that only moved blocks hold.
    """
    windows = rows.mapInArrow(trimmed(_windows), WINDOWS)
    # Written out, so that either side of the join below has a shuffle of its own and Spark can split a hot window's partition.
    shared = cut(windows.groupBy("h1", "h2", "nth").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "at")).alias("o")).where("n > 1").drop("n"))
    o = F.col("o")
    later = F.struct("d", "t") > F.struct(o["d"], o["t"])
    pairs = windows.join(shared, ["h1", "h2", "nth"]).where(later).select("d", "t", o["d"].alias("od"), o["t"].alias("ot"), "at", "n", o["at"].alias("oat"))
    return pairs.repartition("d", "t").sortWithinPartitions("d", "t", "od", "ot").mapInArrow(trimmed(_aligned), SPANS)


def cut_lines(text: str, spans: list[int]) -> tuple[str, int, int]:
    """The text without the worded lines in the spans; how many worded lines it had and has lost."""
    out, n, gone, last_gone, k = [], 0, 0, False, 0
    for line in text.split("\n"):
        if not line.isascii() or line.strip(" \t\v\f\r"):
            while k < len(spans) and n >= spans[k + 1]:
                k += 2
            last_gone = k < len(spans) and n >= spans[k]
            gone += last_gone
            n += 1
        elif not last_gone:
            out.append(line)
            continue
        if not last_gone:
            out.append(line)
    return "\n".join(out), n, gone


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        text = batch.column(names.index("_text"))
        left, n, gone = [], [], []
        for x, spans in zip(text, batch.column(names.index("_lines")), strict=True):
            if x.is_valid:
                a, b, c = cut_lines(x.as_py(), spans.as_py() if spans.is_valid else [])
            else:
                a, b, c = None, 0, 0
            left.append(a)
            n.append(b)
            gone.append(c)
        found = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), batch.column(names.index("_moved"))], names=["text", "n_lines", "n_removed", "n_moved"])
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "found"])


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Every row with a struct column: the text that is left, n_lines (worded), n_removed, and n_moved of these."""
    repeat = ids_repeat(df, id_column)
    spans = common_lines(keyed(df, id_column, text, repeat))
    keys = keyed(df, id_column, text, repeat, whole=True)
    joined = keys.join(spans, ["d", "t"], "left").select("row", F.col("row")[text].alias("_text"), F.col("lines").alias("_lines"), F.coalesce("moved", F.lit(0)).cast("bigint").alias("_moved"))
    name = free_name(df, "line_found")
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).schema["row"].dataType.simpleString()
    out = joined.mapInArrow(trimmed(_cut), f"row {inner}, found struct<text: string, n_lines: bigint, n_removed: bigint, n_moved: bigint>")
    return out.select("row.*", F.col("found").alias(name)), name


def filter_lines(df: DataFrame, id_column: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with their common blocks deleted; rows of which no worded line is left are dropped."""
    found, name = dedup_lines(df, id_column, text)
    x = F.col(name)
    left = found.where((x["n_removed"] == 0) | (x["n_removed"] < x["n_lines"]))
    out = [F.col(f"`{c}`") for c in df.columns]
    out[df.columns.index(text)] = F.when(x["n_removed"] > 0, x["text"]).otherwise(F.col(f"`{text}`")).alias(text)
    if length and length in df.columns:
        out[df.columns.index(length)] = F.when(x["n_removed"] > 0, F.length(x["text"])).otherwise(F.col(f"`{length}`")).cast(df.schema[length].dataType).alias(length)
    return left.select(*out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document."""
    found, name = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    x = F.col(name)
    kept = F.coalesce(x["text"], F.lit(""))
    return found.select("doc_id", x["n_lines"].alias("n_lines"), x["n_removed"].alias("n_removed"), x["n_moved"].alias("n_moved"), F.length(kept).cast("bigint").alias("n_chars"), F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))

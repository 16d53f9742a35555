"""Suffix-array deduplication of repeated substrings.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document with a smaller id, or earlier in the same one.
In suffix-array terms: position p starts a later copy if its longest previous factor, LPF[p], is LENGTH or more.

Suffix arrays are built in shards.  Of every LENGTH-byte string the k-mer with the least hash is its anchor, so equal
strings have equal anchors at equal offsets, and all their occurrences meet in the shard of the anchor's hash.
A shard holds, for each anchor, the bytes that strings with that anchor can cover (its context):

1. Map: anchors with hashes of their contexts.  No text moves.
2. Contexts equal to an earlier one are later copies as a whole.  Only the first of each goes on, and only where its anchor
   has different contexts (the edges of copies).
3. Those contexts' bytes are fetched and sorted as suffixes by prefix doubling, with the longest common prefix of neighbours.  In suffix
   order the previous and next smaller positions are found, with the least common prefix on the way; the larger of the two is LPF,
   the longest previous factor, up to LENGTH.
4. Spans are merged by document and cut from the texts.

Anchors that are very frequent (a line that a third of all documents share) would gather in one shard.  A sample of
documents tells which they are; that changes only the route: their contexts are dealt out string by string, under each string's own
hash, where only equal strings meet and all but the first are later copies.  Whatever the sample has missed is counted exactly
before step 3: an anchor with more than SHARD different contexts is divided by its strings, whose suffix arrays are then built in the
shards of the strings' hashes.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; rows with the same id and text are the
same document and get the same result; of different texts under one id the one with the smaller hash is the earlier; a null id is
smaller than any other; an empty table gives an empty result; columns of any name pass unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import POWERS, U64, Block, blocks, byte_codes, cut, documents, free_name, mix64, trimmed

LENGTH = 100
ANCHOR = 32
REACH = LENGTH - ANCHOR  # an anchor's string starts at most so many bytes before it
BLOCK = 2 << 20
#: Contexts that one suffix array holds; an anchor that has more is divided by its strings.
SHARD = 8_000
#: An anchor is routed as frequent if one of SAMPLE_OF documents show it with HOT contexts or more, and with 1 / HOT_LIST or more of the
#: contexts of all such anchors; so every task is sent HOT_LIST hashes at most.
SAMPLE_OF, HOT, HOT_LIST = 16, 64, 100_000
_CODES = byte_codes(23)
_LEFT, _RIGHT = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


# ------------------------------------------------------------------------------------------- anchors


def _running_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(block: Block) -> dict[str, np.ndarray]:
    """Of each anchor: its document in the block, context start and end in the block, and hashes of anchor and context."""
    data, bounds = block.data, block.bounds
    n = len(data)
    sizes = np.diff(bounds)
    if n < LENGTH or sizes.max(initial=0) < LENGTH:
        none = np.zeros(0, np.int64)
        return {"doc": none, "lo": none, "hi": none, "h": none.view(U64), "c": none.view(U64), "total": np.zeros(1, U64)}
    up, down = POWERS.upto(n + 1)
    total = np.zeros(n + 1, U64)
    values = _CODES[data]
    values *= up[:n]
    np.cumsum(values, out=total[1:])
    hashes = total[ANCHOR:] - total[:-ANCHOR]
    hashes *= down[: len(hashes)]
    hashes = mix64(hashes)
    keyed = (hashes & U64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U64)
    least = _running_min(keyed, REACH + 1)
    # strings that lie within one document
    change = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(sizes >= LENGTH)
    np.add.at(change, bounds[long], 1)
    np.add.at(change, bounds[long + 1] - LENGTH + 1, -1)
    inside = np.cumsum(change[:-1])[: len(least)] > 0
    chosen = np.zeros(n, bool)
    chosen[(least[inside] & U64(0xFFFFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(bounds, at, "right") - 1
    lo = np.maximum(at - REACH, bounds[doc])
    hi = np.minimum(at + LENGTH, bounds[doc + 1])
    c = mix64((total[hi] - total[lo]) * down[lo] + (at - lo).astype(U64) * _LEFT + (hi - at).astype(U64) * _RIGHT)
    return {"doc": doc, "lo": lo, "hi": hi, "h": hashes[at], "c": c, "total": total}


def _first_seen(h: np.ndarray, c: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the first, in ``order``, with their (h, c); and which are not a repetition of an entry at the same place."""
    both = mix64(h * _LEFT + c)
    rank = np.lexsort((order, both))
    first, own = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h):
        ranked, placed = both[rank], order[rank]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        first[rank[new]] = True
        own[rank[new | np.r_[True, placed[1:] != placed[:-1]]]] = True
    return first, own


class _Seen:
    """Of the frequent anchors' strings the earliest place that a task has sent on."""

    def __init__(self) -> None:
        self.rows = np.zeros(0, [("h", "u8"), ("d", "i8"), ("t", "i8"), ("lo", "i8")])

    def later(self, rows: np.ndarray) -> np.ndarray:
        """Which of a block's different strings stand after a place that was sent on; the others are kept in mind."""
        at = np.searchsorted(self.rows["h"], rows["h"])
        at[at == len(self.rows)] = 0
        out = np.zeros(len(rows), bool)
        if len(self.rows):
            old = self.rows[at]
            same = old["h"] == rows["h"]
            after = (rows["d"] > old["d"]) | ((rows["d"] == old["d"]) & ((rows["t"] > old["t"]) | ((rows["t"] == old["t"]) & (rows["lo"] > old["lo"]))))
            out = same & after
            self.rows[at[same & ~after]] = rows[same & ~after]
            rows = rows[~same]
        both = np.concatenate([self.rows, rows])
        self.rows = both[np.argsort(both["h"], kind="stable")]
        return out


def _map_anchors(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in blocks(batch.column(2), BLOCK):
                a = anchors(block)
                if not len(a["doc"]):
                    continue
                doc, lo, hi, h, c, total = (a[x] for x in ("doc", "lo", "hi", "h", "c", "total"))
                if len(hot):
                    at = np.searchsorted(hot, h)
                    at[at == len(hot)] = 0
                    often = hot[at] == h
                    # each string of a frequent anchor under its own hash
                    n = np.maximum(0, hi - lo - LENGTH + 1) * often
                    start = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    string = mix64((total[start + LENGTH] - total[start]) * POWERS.upto(len(total))[1][start] + _RIGHT)
                    rest = ~often
                    doc, lo, hi = (np.concatenate([x[rest], y]) for x, y in ((doc, np.repeat(doc, n)), (lo, start), (hi, start + LENGTH)))
                    h, c = np.concatenate([h[rest], string]), np.concatenate([c[rest], np.zeros(len(string), U64)])
                d, t = ids[block.first : block.first + len(block)], tie[block.first : block.first + len(block)]
                rank = np.empty(len(block), np.int64)
                rank[np.lexsort((t, d))] = np.arange(len(block))
                base = block.bounds[doc]
                first, own = _first_seen(h, c, rank[doc] * (1 << 40) + lo - base)
                if not own.all():  # a string within reach of several frequent anchors
                    doc, lo, hi, base, h, c, first = (x[own] for x in (doc, lo, hi, base, h, c, first))
                whole = np.flatnonzero(first & (c == 0))  # strings of frequent anchors: once a task, not once a block
                if len(whole):
                    rows = np.zeros(len(whole), seen.rows.dtype)
                    rows["h"], rows["d"], rows["t"], rows["lo"] = h[whole], d[doc[whole]], t[doc[whole]], (lo - base)[whole]
                    first[whole[seen.later(rows)]] = False
                # later copies within the block or task need no company: they are dealt out anyhow
                key = np.where(first, h, mix64(h + lo.astype(U64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d[doc]), pa.array(t[doc]), pa.array((lo - base).astype(np.int32)), pa.array((hi - lo).astype(np.int16)), pa.array(~first)],
                    names=["h", "c", "d", "t", "lo", "n", "later"],
                )

    return run


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(2), BLOCK):
            a = anchors(block)
            both = np.unique(np.stack([a["h"].view(np.int64), a["c"].view(np.int64)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["h", "c"])


def frequent_anchors(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the anchors with the most different contexts in a sample of documents; for routing only."""
    some = rows.where(F.pmod(F.xxhash64("d", "t"), F.lit(SAMPLE_OF)) == 0)
    counts = some.mapInArrow(trimmed(_list_anchors), "h bigint, c bigint").distinct().groupBy("h").agg(F.count("*").alias("n"))
    hot = cut(counts.where(F.col("n") >= HOT))
    least = hot.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r.h for r in hot.where(F.col("n") * HOT_LIST >= least).select("h").collect()], np.int64).view(U64))


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, c, d, t, lo): later copies (need false), and firsts whose anchor has other contexts (need true)."""
    names = ["d", "t", "lo", "n", "h", "need"]
    held: list[np.ndarray] | None = None  # the last first, not yet known whether another context follows
    before: list[np.ndarray] | None = None
    multi_before = False

    def batch_of(cols: list[np.ndarray], need: np.ndarray) -> pa.RecordBatch:
        h, _, d, t, lo, n = cols
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(lo), pa.array(n), pa.array(h), pa.array(need)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        later = batch.column(6).to_numpy(zero_copy_only=False)
        if later.any():
            yield batch_of([x[later] for x in cols], np.zeros(int(later.sum()), bool))
            cols = [x[~later] for x in cols]
        h, c = cols[0], cols[1]
        if not len(h):
            continue
        # a row like the one before it in all columns is the same document, read twice
        last = cols if before is None else [np.concatenate([x, y]) for x, y in zip(before, cols, strict=True)]
        new_key, new_place = ([x[1:] != x[:-1] for x in last[:k]] for k in (2, 5))
        first, again = np.logical_or.reduce(new_key), ~np.logical_or.reduce(new_place)
        if before is None:
            first, again = np.r_[True, first], np.r_[False, again]
        later = ~first & ~again
        if later.any():
            yield batch_of([x[later] for x in cols], np.zeros(int(later.sum()), bool))
        before = [x[-1:] for x in cols]
        own = [x[first] for x in cols]
        if held is not None:
            own = [np.concatenate([x, y]) for x, y in zip(held, own, strict=True)]
        h = own[0]
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        multi = np.zeros(len(h), bool)
        multi[1:] |= same
        multi[:-1] |= same
        multi[0] |= held is not None and multi_before
        held, multi_before = [x[-1:] for x in own], bool(multi[-1])
        out = multi[:-1]
        if out.any():
            yield batch_of([x[:-1][out] for x in own], np.ones(int(out.sum()), bool))
    if held is not None and multi_before:
        yield batch_of(held, np.ones(1, bool))


# ------------------------------------------------------------------------------------------- suffix order


def prefix_ranks(text: np.ndarray, length: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rank of each position's next ``length`` (8 or more) bytes in suffix order, by prefix doubling; equal bytes, equal rank.

    With it come the ranks by shorter lengths too, for common prefixes; those of 4 bytes are the bytes themselves.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    first = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    key = np.ascontiguousarray(first).view(">u8").reshape(-1).astype(U64)
    shorter = {4: (key >> U64(32)).astype(np.uint32)}
    span = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        shorter[span] = rank
        if span >= length:
            return rank, shorter
        step = min(span, length - span)
        second = np.zeros(n, np.int32)
        second[:-step] = rank[step:] + 1
        key = (rank.astype(U64) << U64(32)) | second.astype(U64)
        span += step


def common_prefix(shorter: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the texts from positions a and b have in common at their start, ``length`` at most, which both must have."""
    same = np.zeros(len(a), np.int64)
    for span in sorted(shorter, reverse=True):
        ranks = shorter[span]
        some = np.flatnonzero(same + span <= length)
        same[some[ranks[a[some] + same[some]] == ranks[b[some] + same[some]]]] += span
    bytes4 = shorter[4]
    for span in (2, 1):
        some = np.flatnonzero(same + span <= length)
        shift = np.uint32(32 - 8 * span)
        same[some[bytes4[a[some] + same[some]] >> shift == bytes4[b[some] + same[some]] >> shift]] += span
    return same


def previous_smaller(position: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Along the suffix order: the common prefix with the previous entry of a smaller position; 0 if it is below ``least``.

    ``common`` has the common prefixes of neighbours.  An entry looks at the one before it and, where that is not smaller, goes on from
    there to where that one has got to: what lies between is not smaller either.
    """
    back = np.arange(len(position)) - 1
    low = np.concatenate([[0], common]) if len(position) else common
    out = np.zeros(len(position), np.int64)
    live = np.flatnonzero(low >= least)
    live = live[back[live] >= 0]
    while len(live):
        at = back[live]
        found = position[at] < position[live]
        out[live[found]] = low[live[found]]
        live, at = live[~found], at[~found]
        reach, on = np.minimum(low[live], low[at]), back[at]
        low[live], back[live] = reach, on
        live = live[(on >= 0) & (reach >= least)]
    return out


def longest_previous_factor(text: np.ndarray, at: np.ndarray, position: np.ndarray, length: int, least: int = 1) -> np.ndarray:
    """LPF of the entries that start at ``at``, each with ``length`` bytes: the longest common prefix with an entry of a smaller position.

    Values are ``length`` at most; those below ``least`` are given as 0.
    """
    rank, shorter = prefix_ranks(text, length)
    order = np.lexsort((position, rank[at]))
    place, start = position[order], at[order]
    common = common_prefix(shorter, start[:-1], start[1:], length)
    before = previous_smaller(place, common, least)
    after = previous_smaller(place[::-1], common[::-1], least)[::-1]  # next smaller
    out = np.empty(len(at), np.int64)
    out[order] = np.maximum(before, after)
    return out


def later_spans(d: np.ndarray, t: np.ndarray, lo: np.ndarray, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over contexts (id, tie, start; bytes end to end in ``text``): index of the context, start and end of each removed span."""
    begin = np.cumsum(size) - size
    n = np.maximum(0, size - LENGTH + 1)
    owner = np.repeat(np.arange(len(size)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = np.lexsort((t, d))
    document = np.empty(len(d), np.int64)
    document[place] = np.cumsum(np.r_[False, (d[place][1:] != d[place][:-1]) | (t[place][1:] != t[place][:-1])])
    start = lo[owner] + inner
    hit = longest_previous_factor(text, begin[owner] + inner, document[owner] * (1 << 40) + start, LENGTH, LENGTH) >= LENGTH
    owner, start = owner[hit], start[hit]
    if not len(owner):
        return owner, start, start
    edge = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(edge)
    last = np.r_[first[1:], len(start)] - 1
    return owner[first], start[first], start[last] + LENGTH


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor: the spans found by suffix arrays over whole anchor groups."""
    held: pa.Table | None = None

    def solve(table: pa.Table) -> pa.RecordBatch:
        d, t, lo = (table.column(x).to_numpy() for x in ("d", "t", "lo"))
        text = table.column("bytes").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        owner, start, end = later_spans(d, t, lo.astype(np.int64), data, np.diff(offsets))
        return pa.RecordBatch.from_arrays([pa.array(d[owner]), pa.array(t[owner]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["d", "t", "lo", "hi"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows > SHARD:
            h = held.column("h").to_numpy()
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1  # group ends
            fit = cuts[cuts <= SHARD]
            at = int(fit[-1]) if len(fit) else int(cuts[0]) if len(cuts) else 0  # a group has SHARD contexts at most
            if not at:
                break
            yield solve(held.slice(0, at).combine_chunks())
            held = held.slice(at)
    if held is not None and held.num_rows:
        yield solve(held.combine_chunks())


# ------------------------------------------------------------------------------------------- by document


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; touching ones become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[new[1:], True]]


def _by_document(make, schema_names: list[str]):
    """A mapInArrow function over rows sorted by (d, t): one output row a document from ``make(columns)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray], edges: np.ndarray) -> list[tuple]:
            return [make([x[a:b] for x in cols]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(make.types)]
            return pa.RecordBatch.from_arrays(arrays, names=schema_names)

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            d, t = cols[0], cols[1]
            if not len(d):
                continue
            first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
            if len(first) > 1:
                yield emit(out([x[: first[-1]] for x in cols], first))
            held = [x[first[-1] :] for x in cols]
        if held is not None and len(held[0]):
            yield emit(out(held, np.array([0, len(held[0])])))

    return run


class _Gather:
    """Spans merged, and the contexts still to be looked at, of one document."""

    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def __call__(self, c: list[np.ndarray]) -> tuple:
        d, t, lo, n, h, need = c
        a, b = merge(lo[~need], (lo + n)[~need])
        return d[0], t[0], np.stack([a, b], 1).ravel().astype(np.int32), np.stack([lo[need], n[need]], 1).ravel().astype(np.int32), h[need]


class _Merge:
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()))

    def __call__(self, c: list[np.ndarray]) -> tuple:
        d, t, lo, hi = c
        a, b = merge(lo, hi)
        return d[0], t[0], np.stack([a, b], 1).ravel().astype(np.int32)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (d, t, text, needs, keys): each context's bytes."""
    for batch in batches:
        ds, ts, needs, keys = [], [], [], []
        pieces: list[bytes] = []
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py().encode()
            need = batch.column(3)[i].values.to_numpy().reshape(-1, 2)
            pieces += [text[a : a + n] for a, n in need.tolist()]
            ds.append(np.full(len(need), batch.column(0)[i].as_py(), np.int64))
            ts.append(np.full(len(need), batch.column(1)[i].as_py(), np.int64))
            needs.append(need[:, 0])
            keys.append(batch.column(4)[i].values.to_numpy())
            if len(pieces) > 20_000 or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ts)), pa.array(np.concatenate(needs).astype(np.int32)), pa.array(pieces, pa.binary())],
                    names=["h", "d", "t", "lo", "bytes"],
                )
                ds, ts, needs, keys, pieces = [], [], [], [], []


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts: each string of theirs under its own hash."""
    for batch in batches:
        d, t, lo = (batch.column(i).to_numpy() for i in (1, 2, 3))
        text = batch.column(4)
        size = text.cast(pa.large_binary()).value_lengths().to_numpy().astype(np.int64) if hasattr(text, "value_lengths") else np.array([len(x.as_py()) for x in text])
        for i in range(0, len(d), 2_000):
            data = np.frombuffer(b"".join(text.slice(i, 2_000).to_pylist()), np.uint8)
            own = size[i : i + 2_000]
            begin = np.cumsum(own) - own
            up, down = POWERS.upto(len(data) + 1)
            total = np.zeros(len(data) + 1, U64)
            np.cumsum(_CODES[data] * up[: len(data)], out=total[1:])
            n = np.maximum(0, own - LENGTH + 1)
            which = np.repeat(np.arange(len(own)), n)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = begin[which] + inner
            string = mix64((total[start + LENGTH] - total[start]) * down[start] + _RIGHT)
            yield pa.RecordBatch.from_arrays([pa.array(string.view(np.int64)), pa.array(d[i:][which]), pa.array(t[i:][which]), pa.array((lo[i:][which] + inner).astype(np.int32))], names=["h", "d", "t", "lo"])


def _divided(contexts: DataFrame) -> DataFrame:
    """(d, t, lo, hi) of the later copies among the strings of contexts, each string compared under its own hash; hot strings can be split."""
    strings = contexts.mapInArrow(trimmed(_strings), "h bigint, d bigint, t bigint, lo int")
    first = strings.groupBy("h").agg(F.min(F.struct("d", "t", "lo")).alias("o"))
    later = strings.join(first, "h").where(F.struct("d", "t", "lo") > F.col("o"))
    return later.select("d", "t", "lo", (F.col("lo") + LENGTH).alias("hi"))


def find_spans(rows: DataFrame) -> DataFrame:
    """From (d, t, text): (d, t, spans) of the documents that lose bytes; starts and ends in turn, merged, in bytes."""
    hot = frequent_anchors(rows)
    found = rows.mapInArrow(trimmed(_map_anchors(hot)), "h bigint, c bigint, d bigint, t bigint, lo int, n smallint, later boolean")
    sifted = found.repartition("h").sortWithinPartitions("h", "c", "d", "t", "lo")
    sifted = sifted.mapInArrow(trimmed(_sift), "d bigint, t bigint, lo int, n smallint, h bigint, need boolean")
    gathered = sifted.repartition("d", "t").sortWithinPartitions("d", "t")
    gathered = cut(gathered.mapInArrow(_by_document(_Gather(), ["d", "t", "spans", "needs", "keys"]), "d bigint, t bigint, spans array<int>, needs array<int>, keys array<bigint>"))
    asked = gathered.where(F.size("keys") > 0).select("d", "t", "needs", "keys")
    large = cut(asked.select(F.explode("keys").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("h"))
    contexts = rows.join(asked, ["d", "t"]).select("d", "t", "text", "needs", "keys")
    contexts = contexts.mapInArrow(trimmed(_contexts), "h bigint, d bigint, t bigint, lo int, bytes binary")
    divided = None
    if large.head(1):
        divided = _divided(contexts.join(large, "h", "left_semi"))
        contexts = contexts.join(large, "h", "left_anti")
    more = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(_shards), "d bigint, t bigint, lo int, hi int")
    more = more if divided is None else more.unionByName(divided)
    pairs = F.expr("explode(transform(sequence(0, int(size(spans) / 2) - 1), i -> struct(spans[2 * i] AS lo, spans[2 * i + 1] AS hi))) AS s")
    some = gathered.where(F.size("spans") > 0).select("d", "t", pairs).select("d", "t", "s.lo", "s.hi")
    every = some.unionByName(more).repartition("d", "t").sortWithinPartitions("d", "t")
    return every.mapInArrow(_by_document(_Merge(), ["d", "t", "spans"]), "d bigint, t bigint, spans array<int>")


def ids_repeat(df: DataFrame, id_column: str) -> bool:
    """Whether an id stands in several rows; only the id column is read."""
    return bool(df.groupBy(F.col(f"`{id_column}`")).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect())


def keyed(df: DataFrame, id_column: str, text: str, repeat: bool, whole: bool = False) -> DataFrame:
    """Add ``d`` and ``t``, which tell documents apart: the id, and a hash of the text where ids repeat.

    With them come the text, or the whole row as the struct ``row``.
    """
    tie = F.xxhash64(F.col(f"`{text}`")) if repeat else F.lit(0).cast("bigint")
    d = F.coalesce(F.col(f"`{id_column}`").cast("bigint"), F.lit(-(1 << 63)))
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row") if whole else F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    return df.select(d.alias("d"), tie.alias("t"), rest)


FIELDS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, spans): what is left of each text."""
    for batch in batches:
        n, gone, parts, sha = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
            view = memoryview(raw) if raw is not None else memoryview(b"")
            digest, at, lost = hashlib.sha256(), 0, 0
            cuts = spans.values.to_numpy().tolist() if spans.is_valid else []
            for a, b in zip(cuts[0::2], cuts[1::2], strict=True):
                digest.update(view[at:a])
                at, lost = b, lost + b - a
            digest.update(view[at:])
            n.append(len(view))
            gone.append(lost)
            parts.append(len(cuts) // 2)
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, gone, parts)], pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Every row with an array column of the byte spans that repeat earlier bytes (null if none)."""
    repeat = ids_repeat(df, id_column)
    spans = find_spans(keyed(df, id_column, text, repeat)).withColumnRenamed("spans", "_spans")
    name = free_name(df, "repeat_spans")
    out = keyed(df, id_column, text, repeat, whole=True).join(spans, ["d", "t"], "left")
    return out.select("row.*", F.col("_spans").alias(name)), name


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated-substring removal leaves of every document."""
    found, name = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "text", name).mapInArrow(trimmed(_digest), f"doc_id bigint, {FIELDS}")

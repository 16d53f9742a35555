"""Benchmark decontamination by an FM-index per training shard.

The benchmark items' words give a vocabulary and a set of windows (10 consecutive words of an item; an item of fewer
words, but not none, is one window).  Each shard of documents becomes a sequence of word codes.  Words outside the
vocabulary cannot be part of any window, so every run of them is one separator, and runs of vocabulary words shorter than the
shortest window are left out.  Over the rest the shard builds a suffix array, its Burrows-Wheeler transform in a
wavelet tree and sampled suffix positions.  Every window is searched backward through the tree's ranks, occurrences are
located by walking to a sampled position, compared with the documents' bytes, and their word spans are merged.

The benchmark is read in blocks of items of at most BLOCK_WORDS words, which bounds the bytes that are broadcast; each block is a pass over the
documents, which are never shuffled.

Defined cases: a null text or item has no words; word-less items have no windows; repeated item_ids count once, items without an
id as one that is not listed; items with equal windows all count; columns of any name pass unchanged; repeated documents are judged each on their own; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textcore import ALNUM, LOWER, Block, Words, attach, codes_in, documents, free_name, mix64

WINDOW = 10
#: Benchmark words broadcast at once: some 250 MB (measured: see the README), whatever the items.
BLOCK_WORDS = 4_000_000
#: Every so many positions of the text, the suffix array's entry is kept.
SAMPLE = 8
SHARD_BYTES = 2 << 20
#: Windows that are searched at once.
SEARCHED = 1 << 18


# ---------------------------------------------------------------------------------------------- index


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes of ``codes`` in order, a shorter one before those that it begins, by prefix doubling."""
    n = len(codes)
    rank = codes.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    span = 1
    while span < n:
        second = np.zeros(n, np.int64)
        second[:-span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        rank, span = new, 2 * span
        if rank.max() == n - 1:
            break
    return order


class WaveletTree:
    """Ranks of codes in a sequence: one bit vector with running counts a level, most significant bit first."""

    def __init__(self, codes: np.ndarray, top: int) -> None:
        self.levels = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = codes
        for level in range(self.levels):
            bits = (now >> (self.levels - 1 - level)) & 1
            total = np.zeros(len(now) + 1, np.int64)
            np.cumsum(bits, out=total[1:])
            self.ones.append(total)
            self.zeros.append(len(now) - int(total[-1]))
            now = np.concatenate([now[bits == 0], now[bits == 1]])

    def rank(self, code: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each code occurs before each position."""
        low, high = np.zeros_like(upto), upto
        for level in range(self.levels):
            one = ((code >> (self.levels - 1 - level)) & 1).astype(bool)
            total, zeros = self.ones[level], self.zeros[level]
            low = np.where(one, zeros + total[low], low - total[low])
            high = np.where(one, zeros + total[high], high - total[high])
        return high - low


class FMIndex:
    """Backward search over a sequence of codes from 1; 0 stands for the end."""

    def __init__(self, codes: np.ndarray) -> None:
        text = np.append(codes, 0).astype(np.int64)
        order = suffix_array(text)
        self.order_n = len(text)
        self.bwt = text[order - 1]
        top = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletTree(self.bwt, top)
        self.top = top
        marked = order % SAMPLE == 0
        self.marked, self.kept = np.cumsum(np.r_[False, marked]), order[marked]
        self.is_marked = marked

    def search(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of windows: ``length`` codes from ``first`` on in an array of codes; 0 is no code."""
        low, high = np.zeros(len(first), np.int64), np.full(len(first), self.order_n, np.int64)
        live = np.flatnonzero(length > 0)
        step = 0
        while len(live):
            code = codes[first[live] + length[live] - 1 - step].astype(np.int64)
            known = (code <= self.top) & (code > 0)
            code = np.where(known, code, 0)
            base = self.before[code]
            low[live] = np.where(known, base + self.tree.rank(code, low[live]), 0)
            high[live] = np.where(known, base + self.tree.rank(code, high[live]), 0)
            step += 1
            live = live[(high[live] > low[live]) & (length[live] > step)]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk backward to a sampled position."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.is_marked[rows[live]]
            at = live[done]
            out[at] = self.kept[self.marked[rows[at]]] + steps[at]
            live = live[~done]
            code = self.bwt[rows[live]]
            rows[live] = self.before[code] + self.tree.rank(code, rows[live])
            steps[live] += 1
        return out


# ---------------------------------------------------------------------------------------------- benchmark


@dataclass
class Phrases:
    """The windows of some items, kept as places in the items' words, some 60 bytes a word: no window is written out."""

    vocabulary: np.ndarray  # sorted hashes; a word's code is the index + 1
    data: np.ndarray  # the items' lower-cased bytes
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    codes: np.ndarray  # of the words
    first: np.ndarray  # of each different window its first word
    length: np.ndarray  # and its words
    item_from: np.ndarray  # of each window where its items start in item_of
    item_of: np.ndarray  # indexes into ids
    ids: list[str | None]
    bigrams: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.length.min()) if len(self.length) else WINDOW

    def text(self, window: int) -> bytes:
        """A window's words, a space between."""
        a = int(self.first[window])
        b = a + int(self.length[window])
        raw = self.data
        return b" ".join(raw[x:y].tobytes() for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True))

    def items(self, window: int) -> list[int]:
        return self.item_of[self.item_from[window] : self.item_from[window + 1]].tolist()


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """Windows and vocabulary of benchmark items (id, text)."""
    numbers: dict[str | None, int] = {}
    number = np.array([numbers.setdefault(None if i is None else str(i), len(numbers)) for i, _ in items], np.int64)
    raw = [(x or "").encode() for _, x in items]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    block = Block(LOWER[np.frombuffer(b"".join(raw), np.uint8)], bounds, 0)
    del raw
    words = Words(block, ALNUM)
    vocabulary, codes = np.unique(words.hashes(), return_inverse=True)
    codes = (codes + 1).astype(np.int32)
    size = words.counts()
    doc = words.doc()
    pair = np.flatnonzero(doc[:-1] == doc[1:])
    bigrams = np.unique(codes[pair].astype(np.int64) * (len(vocabulary) + 1) + codes[pair + 1])
    del doc, pair
    n = np.where(size > 0, np.maximum(1, size - window + 1), 0)
    item = np.repeat(np.arange(len(items)), n)
    first = words.first[item] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(size[item], window)
    # equal windows by two hashes of their codes
    h = [length.astype(np.uint64), length.astype(np.uint64)]
    for k in range(window):
        some = np.flatnonzero(length > k)
        for i, step in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
            h[i][some] = mix64(h[i][some] * np.uint64(step) + codes[first[some] + k].astype(np.uint64))
    order = np.lexsort((h[1], h[0]))
    new = np.ones(len(order), bool)
    new[1:] = (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1])
    del h
    group = np.cumsum(new) - 1
    both = np.unique(group * max(1, len(numbers)) + number[item[order]])
    item_from = np.searchsorted(both, np.arange(int(new.sum()) + 1) * max(1, len(numbers)))
    kept = order[new]
    small = lambda x: x.astype(np.int32) if len(block.data) < 1 << 31 else x
    return Phrases(
        vocabulary, block.data, small(words.starts), small(words.ends), codes, small(first[kept]), length[kept].astype(np.int16), small(item_from),
        small(both % max(1, len(numbers))), list(numbers), bigrams,
    )


def shard_hits(block: Block, p: Phrases) -> tuple[Words, np.ndarray, list[tuple[int, int]]]:
    """Over one shard: its words, a flag for each word that is hit, and pairs (document, item index)."""
    low = block.lower()
    words = low.words(ALNUM)
    codes = codes_in(words.hashes(), p.vocabulary)
    hit = np.zeros(len(words), bool)
    if not len(p.first) or not codes.any():
        return words, hit, []
    doc = words.doc()
    # Runs of words whose neighbours follow each other somewhere in the benchmark.
    linked = np.zeros(len(codes) + 1, bool)  # word i goes on from word i - 1
    pair = codes[:-1] * (len(p.vocabulary) + 1) + codes[1:]
    both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0) & (doc[:-1] == doc[1:]))
    at = np.searchsorted(p.bigrams, pair[both])
    at[at == len(p.bigrams)] = 0
    if len(p.bigrams):
        linked[both[p.bigrams[at] == pair[both]] + 1] = True
    run_first = np.flatnonzero((codes > 0) & ~linked[:-1])
    run_of = np.cumsum((codes > 0) & ~linked[:-1]) - 1
    size = np.bincount(run_of[codes > 0], minlength=len(run_first))
    keep = size >= p.shortest
    if not keep.any():
        return words, hit, []
    begin, size = run_first[keep], size[keep]
    # The kept runs' codes from 2 on, one separator (1) after each.
    total = int(size.sum() + len(size))
    position = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    source = np.full(total, -1, np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    source[np.repeat(position, size) + inner] = np.repeat(begin, size) + inner
    text = np.where(source >= 0, codes[source] + 1, 1)
    index = FMIndex(text)
    wanted = p.codes + 1
    data = low.data
    raw, pairs = data.tobytes(), set()
    marks = np.zeros(len(words) + 1, np.int64)
    for part in range(0, len(p.first), SEARCHED):
        own_length = p.length[part : part + SEARCHED].astype(np.int64)
        low_row, high_row = index.search(wanted, p.first[part : part + SEARCHED].astype(np.int64), own_length)
        some = np.flatnonzero(high_row > low_row)
        if not len(some):
            continue
        count = (high_row - low_row)[some]
        rows = np.repeat(low_row[some], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        word = source[index.locate(rows)].tolist()
        at = 0
        for w, times in zip((some + part).tolist(), count.tolist(), strict=True):
            n, text, of = int(p.length[w]), p.text(w), p.items(w)
            for i in word[at : at + times]:
                if b" ".join(raw[a:b] for a, b in zip(words.starts[i : i + n], words.ends[i : i + n], strict=True)) != text:
                    continue
                marks[i] += 1
                marks[i + n] -= 1
                pairs.update((int(doc[i]), x) for x in of)
            at += times
    hit = np.cumsum(marks[:-1]) > 0
    return words, hit, sorted(pairs)


# ---------------------------------------------------------------------------------------------- operator

#: ``cut`` is the text without the spans, null where there are none.
FIELDS = "n_words bigint, spans array<bigint>, n_hit bigint, items array<string>, cut string"


def _find(p: Phrases):
    def compute(block: Block) -> list:
        words, hit, pairs = shard_hits(block, p)
        spans: list[list[int]] = [[] for _ in range(len(block))]
        n_hit = np.zeros(len(block), np.int64)
        if hit.any():
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
            doc = words.doc()
            np.add.at(n_hit, doc[hit], 1)
            for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                while a < b:  # a run of hit words may go on in the next text
                    d = int(doc[a])
                    end = min(b, int(words.first[d + 1]))
                    base = int(block.bounds[d])
                    spans[d] += [int(words.starts[a]) - base, int(words.ends[end - 1]) - base]
                    a = end
        items: list[list[str]] = [[] for _ in range(len(block))]
        for d, x in pairs:
            items[d].append(p.ids[x])
        at = block.bounds.tolist()
        cut = [without(block.data[at[d] : at[d + 1]].tobytes(), own) if own else None for d, own in enumerate(spans)]
        return [words.counts(), pa.array(spans, pa.list_(pa.int64())), n_hit, pa.array(items, pa.list_(pa.string())), pa.array(cut, pa.string())]

    return compute


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", words: int = BLOCK_WORDS):
    """Benchmark items in blocks of at most about ``words`` words, one block in the driver at a time."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // (2 * words)))  # a word and the gap after it take two characters at least
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), "t")), F.lit(n)) == k)
        yield n, sorted(((None if r.i is None else str(r.i), r.t) for r in own.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1]))


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, str]:
    """Every row with one struct column: n_words, byte spans to remove (starts and ends in turn), n_hit, item ids."""
    columns = df.columns
    name = free_name(df, "leaks")
    names = []
    for n, items in item_blocks(benchmark, item, item_text):
        shared = df.sparkSession.sparkContext.broadcast(phrases(items))

        def compute(block: Block, shared=shared) -> list:
            return _find(shared.value)(block)

        df, own = attach(df, FIELDS, compute, text, name=name if n == 1 else f"{name}_{len(names)}", size=SHARD_BYTES)
        names.append(own)
    if len(names) > 1:
        df = _merged(df, columns, names, text, name)
    return df, name


def _merged(df: DataFrame, columns: list[str], names: list[str], text: str, name: str) -> DataFrame:
    """Several blocks' findings as one: spans united, hits counted anew over the united spans."""
    spans = F.flatten(F.array(*[F.col(x)["spans"] for x in names]))
    items = F.array_distinct(F.flatten(F.array(*[F.col(x)["items"] for x in names])))
    spans_name, items_name = free_name(df, "all_spans"), free_name(df, "all_items")
    wide = df.select(*[F.col(f"`{c}`") for c in columns], spans.alias(spans_name), items.alias(items_name))
    schema = StructType.fromDDL(f"x struct<{', '.join(f.replace(' ', ':', 1) for f in FIELDS.split(', '))}>")
    out = StructType([*df.select(*[F.col(f"`{c}`") for c in columns]).schema.fields, *schema.fields])
    out.fields[-1].name = name
    out.names[-1] = name

    def run(batches):
        for batch in batches:
            texts, spans, items = (batch.column(batch.schema.get_field_index(c)) for c in (text, spans_name, items_name))
            got = []
            for t, s, i in zip(texts.to_pylist(), spans.to_pylist(), items.to_pylist(), strict=True):
                data = np.frombuffer((t or "").encode(), np.uint8)
                words = Words(Block(LOWER[data], np.array([0, len(data)]), 0), ALNUM)
                united: list[int] = []
                for a, b in sorted(zip(s[0::2], s[1::2], strict=True)):
                    if united and a <= united[-1]:
                        united[-1] = max(united[-1], b)
                    else:
                        united += [a, b]
                hit = sum(int(np.searchsorted(words.starts, b) - np.searchsorted(words.starts, a)) for a, b in zip(united[0::2], united[1::2], strict=True))
                got.append({"n_words": len(words), "spans": united, "n_hit": hit, "items": i, "cut": without(t.encode(), united) if united else None})
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("cut", pa.string())])
            keep = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(got, kind)], names=[*columns, name])

    return wide.mapInArrow(run, out)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with the hit word spans cut out of their texts; ``length`` follows if the input has it.

    Words before and after a cut stay apart: what stood between them and the span is kept.
    """
    found, name = find(df, benchmark, text)
    cut = F.col(name)["cut"]
    out = [F.col(f"`{c}`") for c in df.columns]
    out[df.columns.index(text)] = F.coalesce(cut, F.col(f"`{text}`")).alias(text)
    if length and length in df.columns:
        k = df.columns.index(length)
        out[k] = F.when(cut.isNotNull(), F.length(cut)).otherwise(out[k]).cast(df.schema[length].dataType).alias(length)
    return found.select(*out)


def without(raw: bytes, spans: list[int]) -> str:
    """A UTF-8 text without some byte spans, given as starts and ends in turn."""
    return b"".join(raw[a:b] for a, b in zip([0, *spans[1::2]], [*spans[0::2], len(raw)], strict=True)).decode()


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found, name = find(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    x = F.col(name)
    return found.select(
        "doc_id",
        x["n_words"].alias("n_words"),
        x["n_hit"].alias("n_hit"),
        F.size(x["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(x["items"]), ","), 256).alias("items_sha256"),
        (x["n_hit"] > 0).alias("contaminated"),
    )

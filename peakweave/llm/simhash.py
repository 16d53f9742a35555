"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has 64 bits: bit b is set if more than half of its 3-word shingles' XXH64 hashes have it.
Fingerprints that differ in at most three bits are linked.  Cut into two segments of 32 bits, one segment then differs
by at most one bit; so each fingerprint is indexed under 64 keys, a segment with one bit left out, and two
linked fingerprints meet under an equal key.  Equal fingerprints are merged first, so copies cost one row; the
members of a key are compared exactly and replaced by the edges of a spanning forest, at most one a member.
Components follow from alternating star steps over those edges.

64 rows of 16 bytes are shuffled for each different fingerprint, whatever the texts' length.  A key has 31 bits, so of n different
fingerprints about n / 2**31 share one; a task holds one key's members at a time, 8 bytes each.  A key of more than LARGE members is divided by a second
wildcard: in the other segment at most three bits differ, so of its four bytes one is equal, and only members with an equal byte are compared.

Defined cases: null, empty and word-less texts have fingerprint zero and link like any other; texts of one or two
words are one shingle; repeated rows share their fingerprint and component; null doc_ids are kept and
are never a component's smallest id unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .substrings import ids_repeat, keyed
from .textcore import Block, attach, components, cut, documents, join_wide, trimmed

WORDS_A_SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Shingle hashes whose bits are counted at once.
STEP = 1 << 15
#: Members of a key that are compared with each other.
LARGE = 4096


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text."""
    words = text.lower().split()  # of bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS_A_SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -WORDS_A_SHINGLE].tolist()]
        stops = (ends[WORDS_A_SHINGLE - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        part = hashes[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes))
    return int(bits.view(">u8")[0])


def _fingerprints(block: Block) -> list[np.ndarray]:
    data, at = block.data.tobytes(), block.bounds.tolist()
    return [np.array([fingerprint(data[a:b]) for a, b in zip(at, at[1:], strict=False)], np.uint64).view(np.int64)]


def variants(prints: DataFrame, column: str = "fp") -> DataFrame:
    """The 64 keys of each fingerprint: (key, fp).  A key holds the segment, the left-out bit and the segment's other bits."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    wide = prints.select(column, bit)
    low = F.col("bit") < 32
    segment = F.when(low, F.col(column).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(column, 32))
    gone = F.element_at(F.array(*[F.lit(~(1 << i) & 0xFFFFFFFF) for i in range(32)]), (F.col("bit") % 32 + 1).cast("int"))
    key = segment.bitwiseAND(gone).bitwiseOR(F.element_at(F.array(*[F.lit(i << 32) for i in range(64)]), (F.col("bit") + 1).cast("int")))
    return wide.select(key.alias("key"), F.col(column).alias("fp"))


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among some distinct fingerprints."""
    if len(prints) == 2:
        return [(0, 1)] if int(prints[0] ^ prints[1]).bit_count() <= MAX_BITS else []
    left, edges = np.arange(len(prints)), []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(prints[left] ^ prints[at]) <= MAX_BITS
        found = left[near]
        edges += [(at, int(x)) for x in found]
        queue += found.tolist()
        left = left[~near]
    return edges


def _pairs_of_key(prints: np.ndarray) -> np.ndarray:
    """Edges, as pairs of indexes, whose components are those of all links among a key's members."""
    if len(prints) <= LARGE:
        return np.array(_forest(prints), np.int64).reshape(-1, 2)
    found = [np.zeros((0, 2), np.int64)]
    for byte in range(8):  # both segments' bytes: which of the two the key has is the same for all members and does not matter
        own = (prints >> np.uint64(8 * byte)) & np.uint64(0xFF)
        if (own == own[0]).all():
            continue  # the key's own segment tells nothing
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
        for i, n in zip(first.tolist(), np.diff(np.append(first, len(own))).tolist(), strict=True):
            if n > 1:
                members = order[i : i + n]
                found.append(members[np.array(_forest(prints[members]), np.int64).reshape(-1, 2)])
    return np.concatenate(found)


def _edges_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: the forest's edges of each key with two members or more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key may go on

    def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        size = np.diff(np.r_[first, len(keys)])
        two = first[size == 2]
        near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= MAX_BITS if len(two) else np.zeros(0, bool)
        a, b = [prints[two[near]]], [prints[two[near] + 1]]
        for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = prints[i : i + n]
            pairs = _pairs_of_key(own)
            a.append(own[pairs[:, 0]])
            b.append(own[pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # where the batch's last key starts
        if last or (held and held[-1][0][-1] != keys[0]):
            yield out(*(np.concatenate(x) for x in zip(*held, (keys[:last], prints[:last]), strict=True)))
            held = []
        held.append((keys[last:].copy(), prints[last:].copy()))
    if held:
        yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def link_edges(prints: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp`` whose components are those of all links."""
    dealt = variants(prints).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(trimmed(_edges_of_keys), "a bigint, b bigint").distinct()


def fingerprints(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Every row with a struct column that holds its fingerprint ``fp`` as a signed long."""
    return attach(df, "fp bigint", _fingerprints, text, name="simhash")


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """From rows with ``text``: the rows' other columns with ``fp``, (fp, root, copies) of every distinct fingerprint, and how many rows there are."""
    found, name = fingerprints(rows)
    prints = cut(found.select(*[F.col(c) for c in rows.columns if c != "text"], F.col(name)["fp"].alias("fp")))
    n = prints.count()
    distinct = cut(prints.groupBy("fp").agg(F.count("*").alias("copies")), n)
    roots = components(link_edges(distinct.select("fp")), nodes=distinct.count()).withColumnRenamed("id", "fp")
    return prints, distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), n


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id of the row's component."""
    prints, roots, n = _placed(df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")))
    # a fingerprint's copies are merged before they meet the others of the component
    low = prints.groupBy("fp").agg(F.min("id").alias("low")).join(roots, "fp")
    lowest = low.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("copies").alias("members"))
    # of a class with a large part of all rows, and of a fingerprint with so many copies, the rows stay where they are
    classes = join_wide(roots, lowest, "root", "members", n).select("fp", "component_id", "copies")
    return join_wide(prints, classes, "fp", "copies", n).select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate component, that of its smallest id, with the columns unchanged.

    Rows without an id come after all others; of different texts under one id the one with the smaller hash is the
    component's first; of rows with the same id and text one stays.
    """
    repeat = ids_repeat(df, id_column)
    prints, roots, _ = _placed(keyed(df, id_column, text, repeat))
    first = F.min(F.struct((F.col("d") == F.lit(-(1 << 63))).alias("none"), "d", "t")).alias("first")
    keep = prints.groupBy("fp").agg(first).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.d", "first.t")
    return keyed(df, id_column, text, repeat, whole=True).join(keep, ["d", "t"]).dropDuplicates(["d", "t"]).select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")

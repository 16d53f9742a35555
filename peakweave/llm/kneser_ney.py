"""Quality classifier: interpolated modified Kneser-Ney n-grams trained on trusted text.

Symbols are the bytes of UTF-8 as they stand, the order is ORDER.  Counts of n-grams are gathered from all trusted documents that train and
summed by key; continuation counts, context totals, discounts, interpolation weights and the interpolated probabilities of all
n-grams seen are grouped counts and joins of them, sharded by n-gram and by context.  The model has a row for each different n-gram of
the trusted text and grows with it.  Each text's perplexity is 2 to the mean number of bits a byte, and a text is
kept if it is at most its language's threshold: a high quantile of the perplexity of trusted texts in that language that did not train,
with a margin.

Texts are scored on one of two routes with the same results.  A model of MODEL_ROWS rows or fewer, counted first, is sent to the texts, where
each block looks up its different n-grams once.  A larger one stays sharded: the different n-grams of all texts are joined to
it order by order, and their bits are joined back to the n-grams of each text.

Defined cases: null and empty texts have no perplexity and are not kept; a null language is a language of its own;
a language without trusted texts takes the largest of the other thresholds; without any trusted text every
non-empty text is kept; several labels of one document must all trust it; repeated rows are scored equally; a very long text is scored
like any other; extra columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textcore import Block, attach, blocks, cut, documents, trimmed

ORDER = 5
BITS = 8
SYMBOLS = 1 << BITS
#: Rows of a model that is sent to the texts: 16 bytes each.
MODEL_ROWS = 4_000_000
#: Of the trusted texts one in HOLD does not train but sets the thresholds.
HOLD = 4
#: Threshold: this quantile of the held-out trusted texts' perplexity, times the margin.
QUANTILE = 0.99
MARGIN = 1.05
#: Perplexities are compared in steps of 1 / STEPS bit a byte.
STEPS = 1000
_START = 0x0A  # before a text stand line breaks


def codes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, and the first index of each text."""
    n, k = len(block), ORDER - 1
    sizes = np.diff(block.bounds)
    padded = np.full(len(block.data) + n * k, _START, np.int64)
    place = np.arange(len(block.data)) + np.repeat((np.arange(n) + 1) * k, sizes)
    padded[place] = block.data
    code = padded.copy()
    for i in range(1, ORDER):
        code[i:] |= padded[:-i] << (BITS * i)
    return code[place], block.bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a task's texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        gram, which = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        return gram, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for block in blocks(batch.column(0)):
            if len(block.data):
                which, gram = pd.factorize(codes(block)[0])
                held.append((gram, np.bincount(which)))
                if sum(len(g) for g, _ in held) > 4_000_000:
                    held[:] = [merged()]
    if held:
        gram, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])


def count_tables(texts: DataFrame) -> dict[int, DataFrame]:
    """Counts by order: raw for the highest, numbers of different left neighbours below it.  Rows (gram, n)."""
    top = texts.mapInArrow(trimmed(_count), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    out = {ORDER: cut(top)}
    rows = out[ORDER].count()  # a lower order has no more
    for k in range(ORDER - 1, 0, -1):
        out[k] = cut(out[k + 1].groupBy(_suffix("gram", k).alias("gram")).agg(F.count("*").alias("n")), rows)
    return out


def _suffix(gram: str, k: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << (BITS * k)) - 1))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many n-grams have counts 1 to 4."""
    got = {r.n: r.m for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("m")).collect()}
    n1, n2, n3, n4 = (got.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9  # too few to estimate
    y = n1 / (n1 + 2 * n2)
    own = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(own))


def weights(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Discounted shares (gram, alpha) with their contexts, and interpolation weights of contexts (context, gamma), of one order."""
    d1, d2, d3 = discounts(counts)
    rows = counts.select("gram", "n", F.shiftright("gram", BITS).alias("context"))
    lost = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(lost).alias("lost"))
    alpha = rows.join(totals, "context").select("gram", "context", ((F.col("n") - lost) / F.col("total")).alias("alpha"), (F.col("lost") / F.col("total")).alias("gamma"))
    return alpha, totals.select("context", (F.col("lost") / F.col("total")).alias("gamma"))


def train(texts: DataFrame) -> DataFrame:
    """The model from a column of trusted texts: (kind, gram, value), a row for each n-gram seen and for each context.

    Kind k is an n-gram of k symbols with the probability of its last after the others; kind -k a context of order k with its
    weight of the next lower order.
    """
    tables = count_tables(texts)
    rows = tables[ORDER].count()
    model = lower = None
    for k in range(1, ORDER + 1):
        alpha, gamma = weights(tables[k])
        if lower is None:
            p = alpha.select("gram", (F.col("alpha") + F.col("gamma") / SYMBOLS).alias("p"))
        else:
            alpha = alpha.withColumn("suffix", _suffix("gram", k - 1))
            p = alpha.join(lower.withColumnsRenamed({"gram": "suffix", "p": "below"}), "suffix").select("gram", (F.col("alpha") + F.col("gamma") * F.col("below")).alias("p"))
        lower = cut(p, rows)
        both = lower.select(F.lit(k).alias("kind"), "gram", F.col("p").alias("value")).unionByName(gamma.select(F.lit(-k).alias("kind"), F.col("context").alias("gram"), F.col("gamma").alias("value")))
        model = both if model is None else model.unionByName(both)
    return cut(model, 2 * ORDER * rows)


class Local:
    """A model in memory: by kind, sorted n-grams and their values."""

    def __init__(self, model: DataFrame) -> None:
        table = model.toArrow()
        kind, gram, value = (table.column(c).to_numpy() for c in ("kind", "gram", "value"))
        self.key, self.kinds = uuid.uuid4().hex, {}
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(gram[own])]
            self.kinds[k] = gram[own], value[own]

    def _look(self, kind: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams the kind has, and their values."""
        if kind not in self.kinds:
            return np.zeros(len(gram), bool), np.zeros(len(gram))
        grams, values = self.kinds[kind]
        at = np.searchsorted(grams, gram)
        at[at == len(grams)] = 0
        return grams[at] == gram, values[at]

    def probability(self, gram: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Of the last symbol after the k - 1 before it."""
        if k == 0:
            return np.full(len(gram), 1 / SYMBOLS)
        known, out = self._look(k, gram)
        rest = np.flatnonzero(~known)
        if len(rest):
            seen, gamma = self._look(-k, gram[rest] >> BITS)
            out = out.copy()
            out[rest] = np.where(seen, gamma, 1.0) * self.probability(gram[rest] & ((1 << (BITS * (k - 1))) - 1), k - 1)
        return out


def score(df: DataFrame, model: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Every row with a struct column: n_bytes and bits (mean bits a byte; null for an empty text)."""
    shared = df.sparkSession.sparkContext.broadcast(Local(model))

    def compute(block: Block) -> list:
        code, bounds = codes(block)
        which, gram = pd.factorize(code)
        bits = -np.log2(shared.value.probability(gram))
        total = np.zeros(len(code) + 1)
        np.cumsum(bits[which], out=total[1:])
        sizes = np.diff(bounds)
        return [sizes.astype(np.int64), pa.array(np.diff(total[bounds]) / np.maximum(1, sizes), mask=sizes == 0)]

    return attach(df, "n_bytes bigint, bits double", compute, text, name="perplexity_found")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (hash, text): each text's different n-grams with their numbers."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        for block in blocks(batch.column(1)):
            code, bounds = codes(block)
            if len(code):
                doc = np.repeat(np.arange(len(block)), np.diff(bounds))
                order = np.lexsort((code, doc))
                d, c = doc[order], code[order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])]))
                times = np.diff(np.append(first, len(c)))
                yield pa.RecordBatch.from_arrays([pa.array(key[block.first :][d[first]]), pa.array(c[first]), pa.array(times)], names=["t", "gram", "times"])


def score_by_joins(df: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """(t, n_bytes, bits) of every different text, t being its xxhash64, by joins with the sharded model alone."""
    texts = df.select(F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text")).where(F.col("text") != "").dropDuplicates(["t"])
    counted = cut(texts.mapInArrow(trimmed(_grams), "t bigint, gram bigint, times bigint"))
    left = counted.select("gram").distinct().select("gram", F.col("gram").alias("now"), F.lit(0.0).alias("bits"))
    found = None
    for k in range(ORDER, 0, -1):
        own = model.where(F.col("kind") == k).select(F.col("gram").alias("now"), F.col("value").alias("p"))
        gamma = model.where(F.col("kind") == -k).select(F.col("gram").alias("context"), F.col("value").alias("gamma"))
        looked = left.join(own, "now", "left")
        done = looked.where("p is not null").select("gram", (F.col("bits") - F.log2("p")).alias("bits"))
        found = done if found is None else found.unionByName(done)
        rest = looked.where("p is null").withColumn("context", F.shiftright("now", BITS)).join(gamma, "context", "left")
        left = cut(rest.select("gram", _suffix("now", k - 1).alias("now"), (F.col("bits") - F.log2(F.coalesce("gamma", F.lit(1.0)))).alias("bits")))
    found = found.unionByName(left.select("gram", (F.col("bits") + BITS).alias("bits")))
    n = F.sum("times")
    return counted.join(found, "gram").groupBy("t").agg(n.alias("n_bytes"), (F.sum(F.col("times") * F.col("bits")) / n).alias("bits"))


def trusted_ids(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Ids whose labels all say good quality and not toxic."""
    good = labels.groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.where("_id is not null and q = 1 and t = 0").select("_id")


def thresholds(scored: DataFrame) -> DataFrame:
    """(lang, most): the largest bits a byte that is kept, by language; from rows (lang, bits, trusted).

    What is sorted within a language has a row for each step of perplexity that occurs, not for each text.
    """
    step = F.floor(F.col("bits") * STEPS)
    counts = scored.where("trusted and bits is not null").groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    upto = F.sum("n").over(by.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"upto": upto, "all": F.sum("n").over(by)})
    reached = placed.where(F.col("upto") >= F.col("all") * QUANTILE)
    return reached.groupBy("lang").agg(((F.min("step") + 1) / STEPS + F.log2(F.lit(MARGIN))).alias("most"))


def classify(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang, n_bytes, perplexity, threshold, kept) of every row."""
    rows = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    trusted = trusted_ids(labels)
    holds = F.crc32(F.col("_id").cast("string")) % HOLD == 0
    # The trusted ids grow with the corpus: they are joined by a shuffle at every size, never broadcast.
    model = train(rows.join(trusted.where(~holds).hint("merge"), "_id", "left_semi").select("text"))
    if model.count() <= MODEL_ROWS:
        found, name = score(rows, model)
        x = F.col(name)
        scored = cut(found.select("_id", "lang", x["n_bytes"].alias("n_bytes"), x["bits"].alias("bits")))
    else:
        by_text = score_by_joins(rows, model)
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
        scored = cut(rows.select("_id", "lang", size, F.xxhash64("text").alias("t")).join(by_text.select("t", "bits"), "t", "left").select("_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.col("bits")).alias("bits")))
    flagged = scored.join(trusted.where(holds).withColumn("trusted", F.lit(True)), "_id", "left")
    limit = cut(thresholds(flagged.withColumn("trusted", F.coalesce("trusted", F.lit(False)))), 1)  # a row a language
    other = F.lit(limit.agg(F.max("most")).first()[0]).cast("double")
    judged = scored.join(limit, scored["lang"].eqNullSafe(limit["lang"]), "left").drop(limit["lang"])
    most = F.coalesce("most", other)
    return judged.select(
        F.col("_id").alias("id"), "lang", "n_bytes", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), most).alias("threshold"),
        (F.col("bits").isNotNull() & F.coalesce(F.col("bits") <= most, F.lit(True))).alias("kept"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    found = classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumnRenamed("id", "doc_id")

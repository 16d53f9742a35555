"""Language identification by a string kernel.

Texts are compared by the blended-spectrum presence kernel: the number of character n-grams (N_GRAMS lengths, hashed to
BINS) that both texts have, divided by the geometric mean of how many each has.  Landmarks (Nyström) are training
texts, the same number for each language; kernel ridge regression, one language against the rest, is fitted on a bounded training sample in
the landmarks' feature space; texts are scored by batched matrix products of presence rows, landmarks and weights.

Training rows are those with a text and a language whose crc32(doc_id as text) modulo 3 is not 1.  Of each language the
TRAIN_ROWS rows with the least hash of their id are the training sample (a documented bound, the same at every input size).

Letters are lower-cased, everything else becomes one space.  N-grams are of UTF-8 bytes, never across texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the first language in order;
repeated rows get equal predictions; without any training row every text is ``und``; a null doc_id is neither
held out nor used for training; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textcore import U64, Block, attach, documents, mix64

N_GRAMS = (1, 2, 3, 4)
BINS = 1 << 12
#: Rows of each language that training may use, and landmarks of each language.
TRAIN_ROWS = 400
LANDMARKS = 64
#: Ids with a hash below the share that would give so many times TRAIN_ROWS are looked at; hashes count modulo SLOTS.
SPARE, SLOTS = 4, 1 << 40
RIDGE = 1e-2
UNKNOWN = "und"
#: Presence rows that are held at once.
ROWS = 256

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = U64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def presence(block: Block, first: int, last: int, bins: int = BINS) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams the texts first..last of a block have."""
    lo, hi = int(block.bounds[first]), int(block.bounds[last])
    data = _FOLD[block.data[lo:hi]]
    bounds = block.bounds[first : last + 1] - lo
    out = np.zeros((last - first, bins), np.uint8)
    if not len(data):
        return out
    # runs of spaces count as one; a space stands before and after each text's bytes where it has one
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    data, bounds = data[keep], total[bounds]
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(last - first, dtype=np.int64) * bins, sizes)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(data))  # bytes from here to the text's end
    code = np.zeros(len(data), U64)
    flat = out.reshape(-1)
    for n in range(1, max(N_GRAMS) + 1):
        code = code[: len(data) - n + 1] * _STEP + _BYTE[data[n - 1 :]]
        if not len(code):
            break
        if n in N_GRAMS:
            cell = (mix64(code) >> U64(64 - bins.bit_length() + 1)).astype(np.int64) + row[: len(code)]
            flat[cell[left[: len(code)] >= n]] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # (bins, m), each column divided by the root of its sum
    weights: np.ndarray  # (m, languages)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        size = np.sqrt(np.maximum(1.0, x.sum(1, keepdims=True)))
        return (x @ self.landmarks) / size @ self.weights


def fit(rows: np.ndarray, langs: list[str]) -> Model | None:
    """Nyström landmarks and one-versus-rest kernel ridge regression on some labelled presence rows."""
    languages = sorted(set(langs))
    if not languages:
        return None
    x = rows.astype(np.float32)
    x /= np.sqrt(np.maximum(1.0, x.sum(1, keepdims=True)))
    label = np.array([languages.index(v) for v in langs])
    chosen = np.concatenate([np.flatnonzero(label == k)[:LANDMARKS] for k in range(len(languages))])
    mark = x[chosen].T.copy()
    k_nm = (x @ mark).astype(np.float64)
    k_mm = k_nm[chosen]
    # one against the rest, each language weighing the same
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(label, minlength=len(languages))[label]
    left = k_nm.T * weight
    ridge = RIDGE * k_mm + 1e-8 * np.trace(k_mm) * np.eye(len(chosen))
    return Model(languages, mark, np.linalg.solve(left @ k_nm + ridge, left @ y).astype(np.float32))


def _packed(block: Block) -> list:
    return [pa.array([np.packbits(presence(block, i, i + 1)[0]).tobytes() for i in range(len(block))], pa.binary())]


def train(df: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the labelled rows outside the held-out third, TRAIN_ROWS a language at most.

    Of each language the rows with the least hash of their id are taken; presence rows, not texts, reach the driver.
    """
    rows = df.select(F.col(f"`{id_column}`").alias("i"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("l"))
    rows = rows.where(F.col("i").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")) & has_letter(F.col("text")))
    order = F.xxhash64("i")
    # Rows by language first, so that only those with a hash small enough to be among the least are gathered.
    sizes = rows.groupBy("l").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.l, min(1.0, SPARE * TRAIN_ROWS / r.n))])[F.col("l")]
    near = rows.where(F.pmod(order, F.lit(SLOTS)) < share * SLOTS)
    # Ids once each, however many rows have them; then the TRAIN_ROWS least of each language, joined back by hash and language.
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("o", F.lit(SLOTS)), "o"))
    wanted = near.select("l", order.alias("o")).distinct().withColumn("place", place).where(F.col("place") <= TRAIN_ROWS).select(F.col("l").alias("wl"), F.col("o").alias("wo"))
    chosen = near.join(F.broadcast(wanted), (F.col("l") == F.col("wl")) & (order == F.col("wo")), "left_semi")  # TRAIN_ROWS rows a language
    found, name = attach(chosen, "bits binary", _packed)
    got = sorted((r.l, r.o, bytes(r.b)) for r in found.select("l", order.alias("o"), F.col(name)["bits"].alias("b")).distinct().collect())
    bits = np.unpackbits(np.frombuffer(b"".join(r[2] for r in got), np.uint8)).reshape(len(got), -1)
    return fit(bits, [r[0] for r in got])


def predict(df: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, str]:
    """Every row with a struct column: the predicted language and its score from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bins x landmarks, whatever the input's size

    def compute(block: Block) -> list:
        m = shared.value
        if m is None:
            return [pa.array([UNKNOWN] * len(block)), np.zeros(len(block))]
        best, score = [], []
        for i in range(0, len(block), ROWS):
            s = m.scores(presence(block, i, min(len(block), i + ROWS)))
            top = s.argmax(1)
            best += [m.languages[k] for k in top]
            score.append(np.clip((s[np.arange(len(s)), top].astype(np.float64) + 1) / 2, 0, 1))
        return [pa.array(best), np.concatenate(score)]

    found, name = attach(df, "lang string, score double", compute, text, name="language")
    x, known = F.col(name), has_letter(F.col(f"`{text}`"))
    value = F.struct(F.when(known, x["lang"]).otherwise(UNKNOWN).alias("lang"), F.when(known, x["score"]).otherwise(0.0).alias("score"))
    return found.withColumn(name, value), name


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = documents(spark, sf_dir)
    model = train(docs)
    found, name = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))

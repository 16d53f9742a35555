"""A training corpus from the documents table: five stages, each on what the one before it kept.

Quality rules drop documents; line dedup deletes common blocks and drops documents of which nothing is left; SimHash keeps one
document of each near-duplicate component; decontamination cuts benchmark passages out of texts; SentencePiece
encodes what is left and checks that it decodes.

Defined cases, of all stages unless one says otherwise: null and empty texts have no words, so the first stage drops them (given to a later
one they pass unchanged, but that SimHash keeps one of them all); a null doc_id comes before every other in line dedup and after them in SimHash; null
values in other columns, extra columns and names that operators use inside pass unchanged; rows with one doc_id and different texts are
different documents, with the smaller text hash first; very long texts are read whole; of ties the smaller doc_id wins; an empty table gives an
empty one with the same columns; n_chars follows the text wherever a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm.fmindex import decontaminate
from peakweave.llm.line_dedup import filter_lines
from peakweave.llm.pieces import encode
from peakweave.llm.quality_rules import quality_filter
from peakweave.llm.simhash import keep_one
from peakweave.llm.textcore import delete_at_exit, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep: null, empty and short texts go, repeated rows are judged alike and all kept or dropped."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without blocks of lines that an earlier one has; none that are nothing else.  Repeated rows are one document."""
    return filter_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest doc_id's, a null one last; of repeated rows one."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark; all stay, also those with nothing left, and without a benchmark unchanged."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, its piece ids and whether they decode to it; null texts have null ids and 0 pieces."""
    encoded, name = encode(docs, check=True)
    x = F.col(name)
    rest = [c for c in docs.columns if c != "text"]
    return encoded.select(*rest, F.coalesce(F.size(x["ids"]), F.lit(0)).cast("bigint").alias("n_pieces"), x["ids"].alias("piece_ids"), x["same"].alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("sentencepiece", tokens),
]

#: The quality model, alignment and merges can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; what each returns is written to the shared folder and read again."""
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)  # also where a stage fails
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        now = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = now
    return docs

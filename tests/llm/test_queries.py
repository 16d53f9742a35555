"""The registered queries and the pipeline on the smallest tables, against brute force."""

import sys
from pathlib import Path

import brute
import pytest

from peakweave.llm import licenses
from peakweave.llm.queries import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def _run(spark, name):
    return queries()[name](spark, DATA).collect()


def test_op1(spark, table):
    assert {r.doc_id: tuple(r)[1:] for r in _run(spark, "op1_suffix_dedup")} == brute.op1(table)


def test_op2(spark, table):
    assert {r.doc_id: tuple(r)[1:6] for r in _run(spark, "op2_license_scan")} == {i: brute.op2(x, licenses.BASE) for i, x in table}


def test_op3(spark, table):
    assert {r.doc_id: tuple(r)[1:3] for r in _run(spark, "op3_line_dedup")} == brute.op3(table)


def test_op4(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in _run(spark, "op4_html_extraction"):
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op5(spark, table):
    import sentencepiece
    from pyspark.sql import functions as F

    from peakweave.llm import pieces

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = spark.createDataFrame([(i, None if x is None else library.encode(x)) for i, x in table], "doc_id bigint, ids array<int>")
    want = {r.doc_id: (r.n, r.h) for r in own.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n"), F.xxhash64("ids").alias("h")).collect()}
    rows = _run(spark, "op5_sentencepiece")
    assert {r.doc_id: (r.n_pieces, r.ids_xxhash64) for r in rows} == want and len(rows) == len(table)
    assert all(r.round_trip for r, (_, x) in zip(sorted(rows, key=lambda r: r.doc_id), sorted(table), strict=True) if x is not None)


def test_op6(spark, table):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert sorted(tuple(r) for r in _run(spark, "op6_decontamination")) == sorted(brute.op6(table, items))


def test_op8(spark, table):
    assert sorted(tuple(r) for r in _run(spark, "op8_simhash")) == sorted(brute.op8(table))


def test_op9(spark):
    rows = {r.doc_id: r.kept for r in _run(spark, "op9_quality_classifier")}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good = [rows[r.doc_id] for r in labels if r.quality]
    bad = [rows[r.doc_id] for r in labels if not r.quality]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_op10(spark, table):
    rows = _run(spark, "op10_quality_rules")
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {i: brute.op10(x) for i, x in table}
    assert not any(r.kept and r.base_failed for r in rows)


def test_pipeline(spark, table):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece

    from peakweave.llm import fmindex, pieces, quality_rules
    from peakweave.llm.line_dedup import filter_lines

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = sorted((r.doc_id, r.text) for r in quality_rules.quality_filter(docs).collect())
    assert {i for i, _ in kept} <= {i for i, x in table if not brute.op10(x)[5]}
    counts = brute.op3(kept)
    left = sorted((r.doc_id, r.text) for r in filter_lines(quality_rules.quality_filter(docs)).collect())
    assert {i for i, _ in left} == {i for i, (n, m) in counts.items() if not m or m < n}
    one = {i for i, _, c in brute.op8(left) if i == c}
    assert set(out) == one
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.op6([x for x in left if x[0] in one], items) if not r[5]}
    s = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, x in left:
        if i in clean:
            assert list(out[i].piece_ids) == s.encode(x) and out[i].round_trip
        elif i in one:
            assert brute.op6([(i, s.decode(list(out[i].piece_ids)))], items)[0][2] == 0
    assert fmindex.WINDOW == 10

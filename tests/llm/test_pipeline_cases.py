"""The pipeline's stages on awkward tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, found int, d int, _text string, leaks int"
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows():
    import random

    from samples import prose

    rng = random.Random(9)
    text = lambda: "\n".join(prose(rng, 30).capitalize() + "." for _ in range(4))
    texts = [text() for _ in range(12)]
    passage = prose(rng, 30)
    texts[3] = texts[2]  # a copy
    texts[4] = texts[4] + "\n" + passage + "."
    texts[5] = "\n".join(text() for _ in range(400))  # very long
    rows = [(i, x) for i, x in enumerate(texts)]
    rows += [(6, texts[6]), (7, text()), (None, text()), (None, None), (20, None), (21, ""), (22, " \n"), (23, "#$ " * 80)]
    return [(i, x, None if i == 1 else "en", None, None if x is None or i == 2 else len(x), "r", 1, 2, "t", 3) for i, x in rows], passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, passage = _rows()
    out = tmp_path_factory.mktemp("cases")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None), (None, "")], "item_id bigint, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_stages(spark, folder):
    rows, passage = _rows()
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        kept.append({(r.doc_id, r.text) for r in docs.collect()})
        assert all(r["row"] == "r" and r["found"] == 1 and r["d"] == 2 and r["_text"] == "t" and r["leaks"] == 3 for r in docs.collect())
    texts = {i: x for i, x, *_ in rows[:12]}
    assert {i for i, _ in kept[0]} == {*range(12), None} and len(kept[0]) == len({(i, x) for i, x, *_ in rows if x and len(x) > 300 and i != 23})
    assert (2, texts[2]) in kept[1] and 3 not in {i for i, _ in kept[1]}  # the copy has nothing left
    assert kept[2] == kept[1]
    assert {i for i, _ in kept[3]} == {i for i, _ in kept[2]}
    left = dict(x for x in kept[3] if x[0] == 4)[4]
    assert passage not in left and left.startswith(texts[4].split("\n")[0])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {"n_pieces", "piece_ids", "round_trip"} <= set(last.columns) and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in last.collect())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None)[:3] == [0, 1, 2]


def test_null_and_empty_texts_in_later_stages(spark, folder):
    some = spark.createDataFrame([(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "three words here", None, None, 16)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k, n in ((1, 3), (2, 2), (3, 3), (4, 3)):
        assert corpus_pipeline.STAGES[k][1](spark, some, folder).count() == n


def test_empty_table(spark, folder):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == DOCUMENT)

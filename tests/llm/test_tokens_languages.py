"""Pieces and languages."""

import random
from pathlib import Path

import pytest

from peakweave.llm import language, pieces

model_file = pytest.mark.skipif(not Path(pieces.MODEL).exists(), reason="no tokenizer file")


@model_file
def test_ids_are_the_librarys(docs, rows):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoded, name = pieces.encode(docs)
    got = {r.doc_id: r[name] for r in encoded.collect()}
    assert {i: None if x is None else s.encode(x) for i, x in rows} == got
    decoded, back = pieces.decode(encoded, name)
    assert all(r[back] == r.text for r in decoded.collect())
    checked, name = pieces.encode(docs, check=True)
    assert all(r[name].same for r in checked.collect())


@model_file
def test_odd_texts():
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    m = pieces.model_at(pieces.MODEL)
    rng = random.Random(2)
    for _ in range(200):
        x = "".join(rng.choice("ab e#\n▁日本—'x9 0é\t.”²") for _ in range(rng.randint(0, 300)))
        assert pieces._encoded(m, [x], {}).to_pylist()[0] == s.encode(x)


@model_file
def test_three_ways_to_encode_units(spark, rows):
    import numpy as np

    m = pieces.model_at(pieces.MODEL)
    units = sorted({u for _, x in rows for u in m.split(x or "") if m.plain(u)})
    one = [m.encode_unit(u) for u in units]
    assert [np.frombuffer(x, np.int32).tolist() for x in m.encode_many(units)] == one
    got = {r.unit: r.ids for r in pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), m).collect()}
    assert [got[u] for u in units] == one


@model_file
def test_viterbi_fold(spark):
    """The unigram fold finds the best-scoring path of the lattice."""
    m = pieces.Model(pieces.MODEL)
    m.unigram = True
    units = ["▁hello", "▁readings", "abc", "▁"]
    got = {r.unit: r.ids for r in pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), m).collect()}

    def best(u):
        if not u:
            return 0.0, []
        return max(((m.score[u[:k]] + best(u[k:])[0], [m.ids[u[:k]], *best(u[k:])[1]]) for k in range(1, len(u) + 1) if u[:k] in m.ids), key=lambda x: x[0])

    for u in units:
        score = sum(m.score[p] for p in [next(p for p, i in m.ids.items() if i == j) for j in got[u]])
        assert score == pytest.approx(best(u)[0])


@model_file
def test_empty_and_repeated(spark, empty):
    assert pieces.encode(empty)[0].count() == 0
    df = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id bigint, text string")
    encoded, name = pieces.encode(df)
    assert len({tuple(r[name]) for r in encoded.collect()}) == 1


WORDS = {"en": "the and ing tion with hous water", "de": "der und ung heit mit haus wässer", "fr": "le et ment tion avec maison éau"}


def _languages(spark, n=120):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) + rng.choice(WORDS[lang].split()) for _ in range(30)), lang))
    return spark.createDataFrame([*out, (900, None, "en"), (901, "", "en"), (902, "12 34 !!", "fr"), (903, "der und heit", None), (None, "the and water", "en")], "doc_id bigint, text string, lang string")


def test_languages(spark, empty):
    df = _languages(spark)
    model = language.train(df)
    assert model.languages == ["de", "en", "fr"]
    found, name = language.predict(df.drop("lang"), model)
    got = {r.doc_id: r[name] for r in found.collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    from zlib import crc32

    held = [i for i in range(120) if crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang == truth[i] for i in held) >= 0.95 * len(held)
    assert [got[i].lang for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang == "de" and got[None].lang == "en"
    assert all(0 <= v.score <= 1 for v in got.values())
    assert language.predict(empty.drop("lang"), model)[0].count() == 0
    assert language.train(empty) is None
    none, name = language.predict(df, None)
    assert {r[name].lang for r in none.collect()} == {"und"}


def test_training_leaves_the_held_out_third_alone(spark):
    df = _languages(spark)
    from pyspark.sql import functions as F

    lied = df.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert language.train(lied).languages == ["de", "en", "fr"]


def test_held_out_accuracy_on_test_tables(spark):
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("test tables are not here")
    r = language.op7_language_id(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.95

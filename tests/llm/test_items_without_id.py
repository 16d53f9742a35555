"""Benchmark items without an id are cut out like the others, as the query's SQL counts them."""

import duckdb
import pytest

from peakweave.llm import fmindex
from peakweave.llm.queries import oracle_sql

ITEM = "Seven grey herons waited under the old bridge until the evening rain stopped"


@pytest.mark.parametrize("block_words", [1_000_000, 8])
def test_like_sql(spark, tmp_path, monkeypatch, block_words):
    monkeypatch.setattr(fmindex.item_blocks, "__defaults__", ("item_id", "text", block_words))
    docs = [(1, f"Before it. {ITEM}, and after."), (2, "Nothing of it."), (3, f"{ITEM}. What is the capital of Peru?"), (4, None)]
    items = [(None, ITEM), (None, "What is the capital of Peru"), (7, "the capital of Peru"), (None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in fmindex.op6_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(oracle_sql()["op6_decontamination"]).fetchall())
    assert got[0][2] == 13 and got[0][5]
    left = {r.doc_id: r.text for r in fmindex.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert "herons" not in left[1] and "herons" not in left[3] and "Peru" not in left[3] and left[2] == docs[1][1]

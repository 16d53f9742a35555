"""Sums of pairs in blocks of regions: against the definition, whatever the cuts of blocks and batches, and without a shuffle of products."""

import random

import pytest

from peakweave.operators import moments

SCHEMA = "cell bigint, idx bigint, value double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_by_cell(spark):
    pairs = spark.range(20).selectExpr("id AS i", "id + 1 AS j")
    counts = spark.range(100).selectExpr("id % 7 AS cell", "id % 21 AS idx", "1.0D AS value")
    plan = _plan(moments.pair_moments(pairs, counts, 7))
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "cell#" in line.split("hashpartitioning")[1]]  # rows of pairs and cells are not dealt again


def test_ranks_are_dealt_once(spark):
    counts = spark.range(100).selectExpr("id % 7 AS cell", "id % 21 AS idx", "id % 3 AS value")
    assert _plan(moments.average_ranks(counts, 7)).count("hashpartitioning") == 1


@pytest.mark.parametrize("block, rows", [(256, 10_000), (3, 10_000), (3, 7), (1, 1)])
def test_against_definition(spark, monkeypatch, block, rows):
    draw = random.Random(block * rows)
    monkeypatch.setattr(moments, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        taken = sorted({(draw.randrange(-2, 12), draw.randrange(20)) for _ in range(150)})
        counts = [(c, i, float(draw.randrange(-3, 9))) for c, i in taken]
        counts += [(None, 4, 2.0), (None, 5, 3.0), (3, 6, None), (1 << 60, 7, 5.0), ((1 << 60) + 1, 8, 6.0), (1 << 60, 8, 7.0), (50, 1, 2.0), (50, 1, 3.0), (50, 2, 4.0)]
        pairs = [(i, j) for i in range(22) for j in range(22) if draw.random() < 0.3] + [(7, 8), (1, 2), (1, 2), (4, 5), (21, 0)]
        found = moments.pair_sums(spark.createDataFrame(pairs, "i bigint, j bigint"), spark.createDataFrame(counts, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = [x for x in counts if x[2] is not None]
    power = lambda i, k: sum(v**k for _, r, v in known if r == i)
    product = lambda i, j: sum(x * y for a, p, x in known for b, q, y in known if p == i and q == j and a == b and a is not None)
    want = {(i, j): (product(i, j), power(i, 1), power(i, 2), power(j, 1), power(j, 2)) for i, j in pairs}
    assert len(found) == len(want)
    assert {(r.i, r.j): (r.sxy, r.s_i, r.q_i, r.s_j, r.q_j) for r in found} == want


def test_few_products_at_once():
    import numpy as np

    draw = np.random.default_rng(1)
    i, j = np.triu_indices(30)
    cell, idx = np.nonzero(draw.random((40, 30)) < 0.4)
    value = draw.integers(1, 9, len(cell)).astype(float)
    dense = np.zeros((40, 30))
    dense[cell, idx] = value
    for most in (1, 10, 1 << 20):
        block = moments._Block(i, j)
        block.add_products(cell, idx, value, most)
        assert block.sxy.tolist() == (dense.T @ dense)[block.i, block.j].tolist()


def test_arcs_find_their_links_once(spark):
    """The links are read for their largest score and for their arcs; what finds them runs for one of the two only."""
    from peakweave.operators import plotdata

    rows = spark.createDataFrame([("chr1_1_9", "chr1_11_19", 0.5, 1, 9, 11, 19)], "Peak1 string, Peak2 string, score double, start1 bigint, end1 bigint, start2 bigint, end2 bigint")
    found = rows.mapInArrow(lambda batches: batches, rows.schema)
    arcs = plotdata.arcs(found, 0.1)
    assert "MapInArrow" not in _plan(arcs)
    assert [(r.height, r.alpha) for r in arcs.collect()] == [(1.0, 1.0)]

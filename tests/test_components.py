"""Components: only stars that share a node are settled by rounds; what a task settles by itself is not read again."""

import random

from peakweave.operators import graph


def _edges(spark, pairs):
    loops = [(x, x, 0.0) for x in sorted({x for p in pairs for x in p})]
    return spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs] + loops, "a string, b string, w double")


def _brute(pairs):
    root = {x: x for p in pairs for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def _written(monkeypatch):
    """Rows of every frame whose lineage is cut."""
    rows, cut = [], graph.checkpointed

    def count(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "checkpointed", count)
    return rows


def test_rounds_are_of_stars_that_share_a_node(spark, monkeypatch):
    """A hundred paths near each other in order of names, and one link from the first to the last: rounds hold a few stars, not the nodes."""
    pairs = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(1000) if i % 10 != 9] + [("n0000", "n0999")]
    rows = _written(monkeypatch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.node: r.component for r in graph.component_labels(_edges(spark, pairs)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == _brute(pairs)
    assert rows[0] == 1000 and 0 < max(rows[1:]) <= 20


def test_no_round_where_no_star_shares_a_node(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("d", "e")]
    rows = _written(monkeypatch)
    assert {r.node: r.component for r in graph.component_labels(_edges(spark, pairs).coalesce(1)).collect()} == _brute(pairs)
    assert rows == [5, 0]


def test_components_against_brute_force(spark):
    """Links between far names, so that stars of several tasks share nodes, chains of stars among them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in range(3):
            draw = random.Random(seed)
            pairs = [(f"n{draw.randrange(300):03d}", f"n{draw.randrange(300):03d}") for _ in range(120 + 40 * seed)]
            found = {r.node: r.component for r in graph.component_labels(_edges(spark, pairs)).collect()}
            assert found == _brute(pairs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert graph.component_labels(_edges(spark, [("a", "b")]).where("false")).count() == 0

"""Repeated substrings and lines."""

import brute
import numpy as np
import pytest

from peakweave.llm import line_dedup, substrings


def _digests(df):
    found, name = substrings.remove_repeats(df.select("doc_id", "text"))
    out = found.select("doc_id", "text", name).mapInArrow(substrings._digest, f"doc_id bigint, {substrings.FIELDS}")
    return [(r.doc_id, tuple(r)[1:]) for r in out.collect()]


@pytest.mark.parametrize("hot", [64, 1])
def test_repeats_against_brute_force(docs, rows, hot, monkeypatch):
    """Both routes: anchors as usual, and every anchor as a frequent one."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SAMPLE_OF", 1)
    assert dict(_digests(docs)) == brute.op1(rows)


def test_repeated_rows_and_ids(spark):
    text = "".join(map(chr, np.random.default_rng(0).integers(97, 123, 400)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:150]), (2, None)], "doc_id bigint, text string")
    got = _digests(df)
    assert len(got) == 4
    one = [v for k, v in got if k == 1]
    assert one[0] == one[1] and one[0][:2] == (400, 150)  # its start is in the document without an id, which is earlier
    assert dict(got)[None][1] == 0 and dict(got)[2][:3] == (0, 0, 0)


@pytest.mark.parametrize(("letters", "length"), [(1, 8), (2, 12), (3, 100), (4, 37)])
def test_longest_previous_factor_against_brute_force(letters, length):
    rng = np.random.default_rng(letters)
    text = rng.integers(97, 97 + letters, 500).astype(np.uint8)
    text[300:420] = text[40:160]
    at = np.arange(500 - length + 1)
    raw = text.tobytes()

    def common(i, j):
        return next((k for k in range(length) if raw[i + k] != raw[j + k]), length)

    for position in (at, rng.permutation(at), at // 3):  # also other orders than the text's, and ties
        want = [max((common(i, j) for j in at if position[j] < position[i]), default=0) for i in at]
        assert substrings.longest_previous_factor(text, at, position, length).tolist() == want
        enough = [x if x >= 6 else 0 for x in want]
        assert substrings.longest_previous_factor(text, at, position, length, 6).tolist() == enough


def test_anchors_with_more_contexts_than_a_shard_holds(docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD", 1)
    assert dict(_digests(docs)) == brute.op1(rows)


def test_clashing_names(spark, docs, rows):
    df = docs.select("doc_id", "text", *(docs["found"].alias(c) for c in ("d", "t", "spans", "_spans", "row", "h", "repeat_spans")))
    found, name = substrings.remove_repeats(df)
    assert found.columns[:-1] == df.columns and name not in df.columns
    plain, own = substrings.remove_repeats(docs.select("doc_id", "text"))
    assert sorted(((r.doc_id, r[name]) for r in found.collect()), key=repr) == sorted(((r.doc_id, r[own]) for r in plain.collect()), key=repr)


def test_empty(empty):
    assert _digests(empty) == []
    assert line_dedup.filter_lines(empty).count() == 0


def test_lines_against_brute_force(docs, rows):
    found, name = line_dedup.dedup_lines(docs)
    assert found.columns[:-1] == docs.columns
    got = {r.doc_id: (r[name].n_lines, r[name].n_removed) for r in found.collect()}
    assert got == brute.op3([(i, x) for i, x in rows])
    left = line_dedup.filter_lines(docs).collect()
    assert {r.doc_id for r in left} == {i for i, (n, m) in got.items() if not m or m < n}
    assert all(r.text is None or r.n_chars == len(r.text) for r in left)


def test_patience():
    assert line_dedup.patience([(0, 3), (1, 0), (2, 1), (3, 4), (4, 2)]) in ([1, 2, 3], [1, 2, 4])
    assert line_dedup.patience([]) == []


def test_common_block_spares_edits(spark):
    a = ["one line of five words " + w for w in ("alpha", "beta", "gamma", "delta", "epsilon")]
    b = [*a[:2], "an edited line that differs here", *a[3:], "something new at the very end"]
    df = spark.createDataFrame([(1, "\n".join(a)), (2, "\n".join(b))], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.filter_lines(df).collect()}
    assert got[1] == "\n".join(a) and got[2] == "an edited line that differs here\nsomething new at the very end"

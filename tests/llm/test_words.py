"""Operators on single texts against brute force: licences, benchmark passages, quality rules, fingerprints."""

import brute
import pytest

from peakweave.llm import fmindex, kneser_ney, licenses, quality_rules, simhash
from pyspark.sql import functions as F


def test_quality_statistics(docs, rows):
    found, name = quality_rules.score(docs)
    assert found.columns[:-1] == docs.columns
    got = {r.doc_id: tuple(r[name])[:6] for r in found.collect()}
    assert got == {i: brute.op10(x) for i, x in rows}
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.where(f"{name}.kept").collect()}


def test_quality_rejects_junk_and_keeps_prose(spark):
    import random

    from samples import prose

    rng = random.Random(4)
    good = [(i, "\n".join(prose(rng, 30).capitalize() + "." for _ in range(4))) for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(rng, 90).split())) for i in range(10)] + [(2000 + i, ("SELL NOW!! " + prose(rng, 3).upper() + "!! ") * 40) for i in range(5)]
    df = spark.createDataFrame(good + junk, "doc_id bigint, text string")
    kept = {r.doc_id for r in quality_rules.quality_filter(df).collect()}
    assert kept == {i for i, _ in good}


def test_posterior_against_brute_force(docs):
    found, name = quality_rules.score(docs)
    got = [r[name] for r in found.collect()]
    votes = [[r[f"vote_{k}"] for k in quality_rules.KINDS] for r in got]
    want = brute.op10_model(votes, list(quality_rules.KINDS.values()), quality_rules.START, quality_rules.PRIOR)
    assert all(abs(r.quality - p) < 1e-6 for r, p in zip(got, want, strict=True))
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in got)


def test_accuracy_decides_not_the_number_of_bad_votes():
    """A rule that often condemns what all others praise is outvoted; one that agrees with another condemns alone."""
    n = len(quality_rules.KINDS)
    of = lambda *bad: "".join("0" if k in bad else "2" for k in quality_rules.KINDS)
    model = quality_rules.fit([(of(), 8000), (of("dup_lines"), 600), (of("symbols", "letters"), 900), (of("symbols"), 20)], n)
    chance = dict(zip(quality_rules.KINDS, zip(*model["chance"], strict=True), strict=True))
    assert chance["dup_lines"][0] > 0.05 and chance["symbols"][0] < 0.01

    def good(pattern):
        import math

        p = [math.exp(math.log(s) + sum(math.log(c if v == "0" else 1 - c) for v, c in zip(pattern, row, strict=True))) for s, row in zip(model["shares"], model["chance"], strict=True)]
        return p[0] / sum(p)

    assert good(of("dup_lines")) > 0.5 > good(of("symbols", "letters"))
    assert good(of("symbols")) < good(of("dup_lines"))


def test_one_pass_judges_alike(docs):
    found, name = quality_rules.score(docs)
    once, own = quality_rules.judge(docs)
    assert once.columns == [*(c for c in docs.columns if c != "text"), own]
    assert sorted((r.doc_id, r[own]) for r in once.collect()) == sorted((r.doc_id, r[name]) for r in found.collect())


def test_model_without_documents():
    assert quality_rules.fit([], 9)["share"] == 0.5


def test_licences(spark, docs, rows):
    extra = [(500, "See the GNU General\nPublic License, version 2; MIT licence. CC-BY cc by CC BY-SA"), (501, "apache LICENSE apache license version 2.0"), (502, "amit license mit licenses")]
    df = docs.select("doc_id", "text", "found").unionByName(spark.createDataFrame([(*r, "z") for r in extra], "doc_id bigint, text string, found string"))
    found, name = licenses.scan(df)
    got = {r.doc_id: r[name] for r in found.collect()}
    for i, x in [*rows, *extra]:
        assert tuple(got[i])[:5] == brute.op2(x, licenses.BASE), i
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
        assert 0 <= got[i].score <= 1
    assert "apache-2.0" in got[501].labels and got[502].labels == ""


def test_licence_templates_against_brute_force(spark):
    """Whole licence texts, with words between their clauses, clauses missing, in another order or too far apart."""
    import random

    rng = random.Random(3)
    texts = ["", None]
    for label, parts in licenses.TEMPLATES.items():
        for kind in ("whole", "mandatory", "less", "mixed", "far", "twice"):
            own = [(p, g) for p, g, m in parts if kind != "mandatory" or m]
            if kind == "less":
                own = own[:-1] if parts[-1][2] else own[1:]
            if kind == "mixed":
                own = own[::-1]
            words = []
            for k, (p, g) in enumerate(own * (2 if kind == "twice" else 1)):
                words += ["filler"] * (0 if not k else rng.randint(0, g) if kind != "far" else g + 400) + p.upper().split()
            texts.append(f"{label} , ".replace("-", "x") + " ".join(words) + ". End")
    phrases = [p for parts in licenses.TEMPLATES.values() for p, _, _ in parts if parts[0][0].startswith(("redist", "you can", "permission"))]
    for _ in range(60):  # the same phrases at random places, often more than once
        texts.append(" ".join(rng.choice([*phrases, "filler " * rng.randint(1, 60)]) for _ in range(40)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found, name = licenses.scan(df)
    for r in found.collect():
        base = set(filter(None, r[name].base_labels.split(",")))
        assert set(filter(None, r[name].labels.split(","))) == base | brute.licence_labels(texts[r.doc_id], licenses.TEMPLATES), texts[r.doc_id]
        assert 0 <= r[name].score <= 1 and (r[name].score > 0) == bool(r[name].places)


@pytest.mark.parametrize("block_words", [4_000_000, 40])
def test_benchmark(spark, docs, rows, block_words, monkeypatch):
    items = [(1, " ".join(rows[2][1].split()[5:40])), (2, "two words"), (3, None), (4, "!!"), (2, "two words"), (5, "日本語 —"), (6, rows[5][1][:200]), (7, "ab ab ab ab ab ab ab ab ab ab ab ab")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(fmindex.item_blocks, "__defaults__", ("item_id", "text", block_words))
    found, name = fmindex.find(docs, benchmark)
    got = sorted((r.doc_id, r[name].n_words, r[name].n_hit, len(r[name]["items"]), fmindex.items_digest(r[name]["items"]), r[name].n_hit > 0) for r in found.collect())
    assert got == sorted(brute.op6(rows, items))
    clean = fmindex.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    left = clean.select("doc_id", "text", "n_chars").collect()
    assert all(r.text is None or r.n_chars == len(r.text) for r in left)
    assert {r.doc_id for r in left if r.text != dict(rows)[r.doc_id]} == {x[0] for x in got if x[5]}


def test_columns_like_the_operators_own(spark, docs, monkeypatch):
    """Also where the benchmark takes several blocks."""
    items = spark.createDataFrame([(1, "the river garden water"), (2, "All readers are asked to return this page today."), (3, "river")], "item_id bigint, text string")
    df = docs.select("doc_id", "text", "n_chars", *(docs["found"].alias(c) for c in ("leaks", "leaks_0", "leaks_1", "_all_spans", "all_spans", "all_items", "_all_items", "cut")))
    whole, name = fmindex.find(df, items)
    assert whole.columns[:-1] == df.columns
    monkeypatch.setattr(fmindex.item_blocks, "__defaults__", ("item_id", "text", 2))
    parts, own = fmindex.find(df, items)
    assert parts.columns[:-1] == df.columns and own not in df.columns
    row = lambda r: (r["n_words"], sorted(zip(r["spans"][0::2], r["spans"][1::2], strict=True)), r["n_hit"], sorted(r["items"]), r["cut"])
    assert sorted((r.doc_id, row(r[name])) for r in whole.collect()) == sorted((r.doc_id, row(r[own])) for r in parts.collect())


def test_index_search_and_locate():
    import numpy as np

    text = np.array([1, 2, 1, 2, 2, 1, 2, 1, 2, 2, 3, 1, 2])
    index = fmindex.FMIndex(text)
    for pattern in ([1, 2], [2], [1, 2, 2], [3, 1], [2, 1, 2, 2], [4], [3, 3]):
        low, high = index.search(np.array([9, *pattern, 9]), np.array([1]), np.array([len(pattern)]))
        want = [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_fingerprints_and_components(spark, docs, rows):
    near = [(200 + i, " ".join(["alpha beta gamma delta"] * 30 + [f"w{i}"])) for i in range(6)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*near, (None, "one"), (None, "no other has this text here")], "doc_id bigint, text string"))
    every = [*rows, *near, (None, "one"), (None, "no other has this text here")]
    got = sorted(((r.id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(brute.op8(every), key=repr)
    kept = simhash.keep_one(df.withColumn("kept_id", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("component_id", F.lit(3)))
    assert kept.columns == ["doc_id", "text", "kept_id", "_id", "component_id"]
    left = kept.collect()
    assert len(left) == len({c if c is not None else f for _, f, c in got})
    assert {r.doc_id for r in left} == {c for *_, c in got} and (None, "no other has this text here") in [tuple(r)[:2] for r in left]


def test_keep_one_of_repeated_ids(spark):
    a, b = " ".join(f"first{i}" for i in range(60)), " ".join(f"second{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (1, b), (1, a), (None, a), (None, b + " x y z"), (None, "third")], "doc_id bigint, text string")
    left = sorted((tuple(r) for r in simhash.keep_one(df).collect()), key=repr)
    want = {a, b, "third"} | ({b + " x y z"} if (brute.fingerprint(b) ^ brute.fingerprint(b + " x y z")).bit_count() > 3 else set())
    assert sorted(t for _, t in left) == sorted(want)


@pytest.mark.parametrize("large", [4096, 3])
def test_links_of_random_fingerprints(spark, large, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "LARGE", large)

    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 4, 3)]]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    from peakweave.llm.textcore import components

    roots = {r.id: r.root for r in components(simhash.link_edges(df)).collect()}
    linked = np.bitwise_count(prints[:, None] ^ prints) <= 3
    for i, x in enumerate(prints.view(np.int64).tolist()):
        seen = {i}
        while True:
            more = set(np.flatnonzero(linked[sorted(seen)].any(0)).tolist())
            if more <= seen:
                break
            seen |= more
        assert roots.get(x, x) == min(prints.view(np.int64)[sorted(seen)].tolist())


def test_large_keys_are_divided(monkeypatch):
    """Thousands of fingerprints under one key: the components are those of all links."""
    import numpy as np

    rng = np.random.default_rng(1)
    low = rng.integers(0, 2**32, 1500, dtype=np.uint64)
    low = np.unique(np.concatenate([low, *[low[:400] ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(32, k, replace=False)) for k in (1, 2, 3, 4)]]))
    prints = low | np.uint64(0x1234567800000000)

    def groups(pairs):
        root = list(range(len(prints)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            root[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(prints))]

    every = groups(np.argwhere(np.bitwise_count(prints[:, None] ^ prints) <= 3).tolist())
    for large in (10, 10_000):
        monkeypatch.setattr(simhash, "LARGE", large)
        assert groups(simhash._pairs_of_key(prints).tolist()) == every


def test_kneser_ney_is_a_distribution(spark):
    """Probabilities of all symbols after seen and unseen contexts sum to one."""
    import numpy as np

    texts = spark.createDataFrame([("the cat sat on the mat. the cat ran.\nthe hat is on the cat",)] * 3 + [("another text entirely, with other words",)], "text string")
    model = kneser_ney.Local(kneser_ney.train(texts))
    for context in (b"the ", b" cat", b"qqqq", b"xthe", b"\n\n\n\n"):
        code = int.from_bytes(context, "big") << 8
        p = model.probability(code + np.arange(256))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_kneser_ney_counts_against_brute_force(spark, docs, rows):
    from collections import Counter

    raw = Counter()
    for _, x in rows:
        b = b"\n" * 4 + (x or "").encode()
        raw.update(b[i : i + 5] for i in range(len(b) - 4))
    code = lambda g: int.from_bytes(g, "big")
    tables = kneser_ney.count_tables(docs.select("text"))
    assert {r.gram: r.n for r in tables[5].collect()} == {code(g): n for g, n in raw.items()}
    below = Counter(g[1:] for g in raw)
    assert {r.gram: r.n for r in tables[4].collect()} == {code(g): n for g, n in below.items()}


def test_perplexity_against_brute_force_on_both_routes(spark, docs, rows):
    """Bits of every text, also very long, repeated, null and empty ones, from the formulas."""
    trained = [x for _, x in rows[:30]]
    want = brute.kneser_ney(trained, [x for _, x in rows], kneser_ney.ORDER)
    model = kneser_ney.train(spark.createDataFrame([(x,) for x in trained], "text string"))
    found, name = kneser_ney.score(docs.select("doc_id", "text"), model)
    got = {r.doc_id: r[name].bits for r in found.collect()}
    assert all((got[i] is None) == (w is None) and (w is None or abs(got[i] - w) < 1e-9) for (i, _), w in zip(rows, want, strict=True))
    joined = {r.t: r for r in kneser_ney.score_by_joins(docs, model).collect()}
    hashes = {r.doc_id: r.t for r in docs.select("doc_id", F.xxhash64("text").alias("t")).collect()}
    assert all(w is None or abs(joined[hashes[i]].bits - w) < 1e-9 for (i, _), w in zip(rows, want, strict=True))
    assert all(not x or joined[hashes[i]].n_bytes == len(x.encode()) for i, x in rows)


def test_routes_agree(docs, spark, rows, monkeypatch):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows[:50]], "doc_id bigint, quality int, toxic int")
    twice = docs.unionByName(docs)
    one = sorted(((r.id, r.kept, round(r.perplexity or 0, 6)) for r in kneser_ney.classify(twice, labels).collect()))
    monkeypatch.setattr(kneser_ney, "MODEL_ROWS", 0)
    assert sorted(((r.id, r.kept, round(r.perplexity or 0, 6)) for r in kneser_ney.classify(twice, labels).collect())) == one and len(one) == 2 * len(rows)


def test_classifier_verdicts(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows[:40]] + [(0, 0, 0), (1, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all(got[i].kept for i, _ in rows[2:40])
    assert not got[60].kept and got[60].perplexity is None and not got[61].kept
    assert not got[68].kept  # signs
    none = {r.id: r.kept for r in kneser_ney.classify(docs, labels.limit(0)).collect()}
    assert none[5] and not none[61]
    assert kneser_ney.classify(empty, labels).count() == 0


def test_empty_tables(spark, empty):
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert quality_rules.quality_filter(empty).count() == 0
    assert licenses.scan(empty)[0].count() == 0
    assert fmindex.decontaminate(empty, benchmark).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_no_benchmark(spark, docs):
    found, name = fmindex.find(docs, spark.createDataFrame([], "item_id bigint, text string"))
    assert found.where(F.col(name)["n_hit"] > 0).count() == 0


@pytest.mark.parametrize("wide", [1000, 5, 0])
def test_hot_keys_are_joined_like_others(spark, wide, monkeypatch):
    """A hub with a third of all links and a text with a third of all rows, with most, few or no keys sent to their rows."""
    import random

    from peakweave.llm import textcore

    monkeypatch.setattr(textcore, "WIDE", wide)
    rng = random.Random(wide)
    edges = [(500, 1000 + i) for i in range(60)] + [(i, i + 1) for i in range(40)] + [tuple(rng.sample(range(2000, 2200), 2)) for _ in range(80)]
    root = {x: x for e in edges for x in e}
    for _ in root:  # smallest ids spread until nothing changes
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = textcore.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted((r.id, r.root) for r in found.collect()) == sorted(x for x in root.items() if x[0] != x[1])

    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    rows = [(i, texts[0] if i % 3 == 0 else rng.choice(texts)) for i in range(90)] + [(None, texts[0]), (7, texts[1]), (90, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(((r.id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(brute.op8(rows), key=repr)

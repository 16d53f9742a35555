import numpy as np
import pandas as pd
import pytest

import peakweave as pw
from peakweave.operators import graph, links, metacells, network, plotdata, regions as reg, windows
from peakweave.sources import tables
from peakweave.streaming import moments as stream


@pytest.fixture(scope="module")
def atac(spark):
    rng = np.random.default_rng(3)
    names = [f"chr1_{i}_{i + 50}" for i in range(1, 60_000, 2000)]
    base = rng.poisson(2, (40, 1))
    frame = pd.DataFrame(rng.poisson(1.0, (40, len(names))) + base * (rng.random((40, len(names))) < 0.6), columns=names)
    counts, regions, n = tables.counts_from_pandas(spark, frame)
    return pw.Atac(counts.cache(), regions.cache(), n)


def _regions(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["peak"]))


def test_order_is_by_text(spark):
    got = reg.add_region_infos(_regions(spark, [("chr2_5_9",), ("chr10_5_9",), ("chr2_1_9",)])).orderBy("idx").collect()
    assert [r.peak for r in got] == ["chr10_5_9", "chr2_1_9", "chr2_5_9"]


def test_malformed_names(spark):
    for bad in ("chr1_1", "chr1_1_2_3", None):
        with pytest.raises(ValueError):
            reg.parse_regions(_regions(spark, [("chr1_1_2",), (bad,)]))
    with pytest.raises(KeyError):
        reg.subset_region(_regions(spark, [("chr1_1_2",)]), "chr1", 1, 2)


def test_windows_against_definition(spark):
    rng = np.random.default_rng(0)
    rows = [(f"chr1_{s}_{s + int(rng.integers(1, 900))}",) for s in rng.integers(0, 5000, 80).tolist()]
    r = reg.add_region_infos(_regions(spark, sorted(set(rows))))
    w = 700
    got = {(x.off, x.w, x.idx) for x in windows.window_members(r, w).collect()}
    data = r.toPandas()
    want = set()
    for off in (0, 1):
        for k, ws in enumerate(range(off * (w // 2), int(data.end.max()), w)):
            for x in data.itertuples():
                if ws < x.start < ws + w - 1 or ws < x.end < ws + w - 1:
                    want.add((off, k, x.idx))
    assert got == want


def test_reconcile_values(spark):
    cover = spark.createDataFrame([(i, [(0, 0), (1, 0)]) for i in (0, 1, 2)], "idx bigint, windows array<struct<off: int, w: bigint>>")
    scores = spark.createDataFrame([(0, 0, 1, 1.0), (1, 0, 1, -1.0), (0, 0, 2, 2.0), (1, 0, 2, 4.0), (0, 1, 2, 3.0)], "off int, i bigint, j bigint, score double")
    got = {(r.i, r.j): r.score for r in links.reconcile(scores, cover).collect()}
    assert got == {(0, 2): 3.0, (1, 2): 1.5}


def test_whole_pipeline(spark, atac, tmp_path):
    pw.compute_atac_network(atac, window_size=20_000, distance_constraint=10_000, n_samples=2, n_samples_maxtry=10, max_alpha_iteration=5)
    found = pw.extract_atac_links(atac)
    rows = found.collect()
    assert rows and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    with pytest.raises(KeyError):
        pw.extract_atac_links(atac, "other")
    with_modules = pw.add_ccans(atac, coaccess_cutoff_override=0.0)
    assert "CCAN" in with_modules.regions.columns and with_modules.regions.count() == atac.regions.count()
    shown = pw.plot_connections(atac, "chr1", 0, 60_000, abs_threshold=0.0)
    assert shown[0].count() and shown[1].count()
    module = with_modules.regions.where("CCAN IS NOT NULL").first().CCAN
    assert pw.plot_ccan(with_modules, module, abs_threshold=0.0)[1].count()
    tables.write_network(atac.networks["atac_network"], str(tmp_path / "nets"))
    assert tables.read_network(spark, str(tmp_path / "nets")).count() == atac.networks["atac_network"].count()
    with pytest.raises(KeyError):
        tables.read_network(spark, str(tmp_path / "nets"), "none")


@pytest.mark.parametrize("method", ["cov", "corrcoef", "spearman", "kendalltau"])
def test_other_coefficients(atac, method):
    got = network.network_of(atac.counts, atac.regions, atac.n_cells, 0.5, 20_000, init_method=method)
    assert got.count() > 0


def test_errors(spark, atac):
    with pytest.raises(ValueError):
        pw.sliding_graphical_lasso(pw.Atac(atac.counts, atac.regions, 1), window_size=20_000)
    with pytest.raises(ValueError):
        pw.sliding_graphical_lasso(pw.Atac(atac.counts, atac.regions.limit(1), 40), window_size=20_000)
    with pytest.raises(RuntimeError):
        network.average_alpha(atac.counts, atac.regions, 40, 20_000, distance_constraint=1e9)
    with pytest.raises(ValueError):
        pw.plot_connections("text", "chr1", 0, 1)


def test_cutoffs(spark):
    chain = [(f"chr1_{i}_{i + 1}", f"chr1_{j}_{j + 1}", 0.6) for g in (0, 10, 20) for i in range(g, g + 4) for j in range(i + 1, g + 4)]
    weak = [("chr1_3_4", "chr1_10_11", 0.2), ("chr1_13_14", "chr1_20_21", 0.2)]
    df = spark.createDataFrame(chain + weak, "Peak1 string, Peak2 string, score double")
    assert 0 <= graph.find_ccan_cutoff(df, tolerance_digits=1) <= 1
    got = graph.find_ccans(df, coaccess_cutoff_override=0.3).collect()
    assert len({r.CCAN for r in got}) == 3 and len(got) == 12
    assert not graph.find_ccans(df.withColumn("score", -df.score), coaccess_cutoff_override=0.8).collect()
    assert graph.ccan_edges(df, 0.9).count() == 0
    with pytest.raises(AssertionError):
        graph.find_ccans(df, coaccess_cutoff_override=2.0)


def test_communities_of_many_components(spark):
    """As of each component alone, over several batches, in few calls of Python and each solved once."""
    from peakweave.kernels.louvain import louvain

    rng = np.random.default_rng(2)
    parts = [[(f"c{g:03}_{a}", f"c{g:03}_{b}", float(w)) for a, b, w in zip(*rng.integers(0, 9, (2, 14)), rng.integers(1, 9, 14), strict=True) if a < b] for g in range(60)]
    df = spark.createDataFrame([e for part in parts for e in part], "a string, b string, w double").groupBy("a", "b").agg({"w": "max"}).toDF("a", "b", "w").cache()
    rows = sorted(map(tuple, df.collect()))
    total = sum(r[2] for r in rows)
    label = {r.node: r.component for r in graph.component_labels(df).collect()}
    want = {}
    for c in set(label.values()):
        own = [r for r in rows if label[r[0]] == c]
        found = louvain(sorted({v for r in own for v in r[:2]}), own, 42, total)
        want |= {v: min(u for u in found if found[u] == found[v]) for v in found}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = graph.communities(df)
        assert {r.node: r.community for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # a call a component took most of the time
    sizes = pd.Series(want.values()).value_counts()
    assert graph.number_of_ccans(df.withColumnsRenamed({"a": "Peak1", "b": "Peak2", "w": "score"}), 0.0) == (sizes >= 3).sum()


def test_metacells(spark, atac):
    one = metacells.compute_metacells(atac.counts, atac.regions, atac.n_cells, k=10, max_metacells=1)
    assert one.select("cell").distinct().count() == 1
    none = metacells.compute_metacells(atac.counts, atac.regions, atac.n_cells, k=10, max_overlap_metacells=0)
    assert none.select("cell").distinct().count() >= 1
    with pytest.raises(ValueError):
        metacells.compute_metacells(atac.counts, atac.regions, atac.n_cells, dim_reduction="other")
    with pytest.raises(ValueError):
        metacells.compute_metacells(atac.counts.where("idx > 0"), atac.regions, atac.n_cells)


def test_lsi_is_the_svd(atac):
    x = metacells.lsi_normalize(atac.counts, atac.n_cells).toPandas().pivot_table(index="cell", columns="idx", values="value", fill_value=0.0)
    u = np.linalg.svd(x.to_numpy(), full_matrices=False)[0][:, :4]
    u = u * np.where(u[np.abs(u).argmax(0), range(4)] < 0, -1, 1)
    want = (u - u.mean(1, keepdims=True)) / u.std(1, ddof=1, keepdims=True)
    got = metacells.lsi(atac.counts, atac.n_cells, 4, rounds=30).toPandas().sort_values("cell")
    assert got.cell.tolist() == x.index.tolist()
    assert np.allclose(np.stack(got.vec), want, atol=1e-3)


@pytest.mark.parametrize(("cells", "regions"), [(12, 40), (40, 12)])
def test_lsi_brings_only_the_smaller_side(spark, monkeypatch, cells, regions):
    """The SVD from either side; no basis or list of ids in the driver is longer than the smaller one."""
    rng = np.random.default_rng(5)
    X = rng.poisson(1.0, (cells, regions)) + 3.0 * np.outer(rng.random(cells) > 0.5, rng.random(regions) > 0.5)
    X[:, 0] += 1
    X[0] += 1
    counts, _, n = tables.counts_from_pandas(spark, pd.DataFrame(X, columns=[f"chr1_{i}_{i + 5}" for i in range(1, 10 * regions, 10)]))
    x = metacells.lsi_normalize(counts, n).toPandas().pivot_table(index="cell", columns="idx", values="value", fill_value=0.0)
    u = np.linalg.svd(x.to_numpy(), full_matrices=False)[0][:, :3]
    u = u * np.where(u[np.abs(u).argmax(0), range(3)] < 0, -1, 1)
    qr, sizes = np.linalg.qr, []
    monkeypatch.setattr(np.linalg, "qr", lambda a, *r: sizes.append(len(a)) or qr(a, *r))
    got = metacells.lsi(counts, n, 3, rounds=3).toPandas().sort_values("cell")
    assert got.cell.tolist() == x.index.tolist()
    assert np.allclose(np.stack(got.vec), (u - u.mean(1, keepdims=True)) / u.std(1, ddof=1, keepdims=True), atol=1e-3)
    assert set(sizes) == {min(cells, regions)}


def test_select_metacells_order(spark):
    near = spark.createDataFrame([(c, n) for c, s in ((0, (0, 1, 2)), (1, (0, 1, 2)), (2, (1, 2, 3)), (3, (3, 4, 5))) for n in s], "cell bigint, neighbor bigint")
    got = metacells.select_metacells(near, 3, 0.5).toPandas().groupby("metacell").cell.apply(sorted).tolist()
    assert got == [[0, 1, 2], [3, 4, 5]]


@pytest.mark.parametrize("overlap", [0.2, 0.5, 0.9])
def test_select_metacells_is_greedy(spark, overlap):
    rng = np.random.default_rng(7)
    k, sets = 6, {c: set(((c + rng.choice(9, 6, replace=False)) % 60).tolist()) for c in range(60)}
    accepted = []
    for c in range(60):
        if all(len(sets[c] & sets[a]) < overlap * k for a in accepted):
            accepted.append(c)
    near = spark.createDataFrame([(c, int(n)) for c, s in sets.items() for n in s], "cell bigint, neighbor bigint")
    got = metacells.select_metacells(near, k, overlap).toPandas().groupby("metacell").cell.apply(set).tolist()
    assert got == [sets[c] for c in accepted]


def test_gene_errors(spark):
    genes = spark.createDataFrame([("chr1", 100_000, 200_000, None, "+")], "chromosome string, start bigint, end bigint, genename string, strand string")
    assert pw.plot_genes(genes, "chr1", 0, 300_000).first().genename == "unknown"
    with pytest.raises(ValueError):
        plotdata.genes_in(genes, "chr2", 0, 1)
    with pytest.raises(ValueError):
        plotdata.genes_in(genes, "chr1", 0, 1)
    with pytest.raises(ValueError):
        plotdata.genes_in(genes.drop("genename"), "chr1", 0, 1)


def test_stream_of_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0), (0, 2, 1.0)], "cell bigint, idx bigint, value double").write.parquet(source)
    df = spark.readStream.schema("cell bigint, idx bigint, value double").parquet(source)
    q = stream.start_region_sums(df, "sums_test", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.idx, r.n, r.sx, r.sxx) for r in spark.sql("SELECT * FROM sums_test").collect()} == {(1, 2, 5.0, 13.0), (2, 1, 1.0, 1.0)}


def test_order_statistics(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.round(np.concatenate([rng.normal(size=3000), np.zeros(2000), [1e6]]), 3)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "score double")
    monkeypatch.setattr(links, "FEW", 20)
    monkeypatch.setattr(links, "BINS", 16)
    ranks = [0, 1, 2499, 2500, 4999, 5000]
    assert links.order_statistics(df, "score", ranks) == {k: float(np.sort(values)[k]) for k in ranks}
    got = {r.p: r.value for r in links.score_quantiles(df, [0.1, 0.5, 0.99]).collect()}
    assert got == pytest.approx({p: float(np.quantile(values, p)) for p in got})


def test_holder_functions(spark, atac):
    again = pw.add_region_infos(atac)
    assert again.regions.count() == 30 and again.counts.agg({"value": "sum"}).first() == atac.counts.agg({"value": "sum"}).first()
    assert [r.idx for r in pw.sort_regions(atac).regions.orderBy("start").collect()] == list(range(30))
    part = pw.subset_region(pw.Atac(atac.counts, atac.regions, 40, {"n": spark.createDataFrame([(0, 1, 0.5), (0, 29, 0.1)], "i bigint, j bigint, score double")}), "chr1", 0, 10_000)
    assert part.regions.count() == 5 and part.counts.agg({"idx": "max"}).first()[0] == 4 and part.networks["n"].count() == 1
    few = pw.compute_metacells(atac, k=10, method="sum")
    assert 1 <= few.n_cells <= 40 and few.counts.select("idx").distinct().count() == 30
    own = pw.Atac(atac.counts, atac.regions, 40, embeddings={"given": spark.createDataFrame([(i, [float(i)]) for i in range(40)], "cell bigint, vec array<double>")})
    assert pw.compute_metacells(own, k=4, dim_reduction="given", max_metacells=1).n_cells == 1
    with pytest.raises(ValueError):
        pw.compute_metacells(atac, projection="umap")


def test_plot_of_links_and_genes(spark):
    links_ = spark.createDataFrame([("chr1_100000_100050", "chr1_200000_200050", 0.8), ("chr1_100000_100050", "chr1_300000_300050", -0.2)], "Peak1 string, Peak2 string, score double")
    genes = spark.createDataFrame([("chr1", 100_000, 200_000, "GENE1", "+")], "chromosome string, start bigint, end bigint, genename string, strand string")
    arcs, boxes, tracks = pw.plot_connections_genes(links_, genes, "chr1", 90_000, 400_000)
    assert [(r.center, r.width, r.sign, r.alpha) for r in arcs.collect()] == [(150_025.0, 100_000.0, "positive", 1.0)]
    assert boxes.count() == 3 and tracks.first().track == 0
    with pytest.warns(UserWarning):
        pw.plot_connections(links_, "chr1", 90_000, 400_000, key="x")
    with pytest.raises(ValueError):
        pw.plot_connections(links_, "chr2", 0, 1)


def test_genes_from_a_file(spark, tmp_path):
    path = str(tmp_path / "genes.csv")
    with open(path, "w") as f:
        f.write("chromosome_name,start_position,end_position,strand,external_gene_name\n1,10,20,1,A\nX,5,9,-1,\n")
    got = tables.read_genes(spark, path, "csv", header="true", inferSchema="true").collect()
    assert {(r.chromosome, r.strand, r.genename) for r in got} == {("chr1", "+", "A"), ("chrX", "-", None)}


def test_plots_with_other_column_names(spark):
    import peakweave as pw

    links = spark.createDataFrame([("chr1_100000_100050", "chr1_200000_200050", 0.8)], "a string, b string, w double")
    arcs, boxes = pw.plot_connections(links, "chr1", 0, 300_000, peak1_col="a", peak2_col="b", score_col="w")
    assert arcs.first().score == 0.8 and boxes.count() == 2
    with pytest.raises(ValueError):
        pw.plot_connections(links, "chr1", 0, 300_000)
    genes = spark.createDataFrame([("chr1", 100_000, 200_000, "G", "+")], "c string, s bigint, e bigint, n string, t string")
    names = {"chromosome_col": "c", "start_col": "s", "end_col": "e", "name_col": "n", "strand_col": "t"}
    assert pw.plot_genes(genes, "chr1", 0, 300_000, **names).first().track == 0
    with pytest.raises(ValueError):
        pw.plot_genes(genes, "chr1", 0, 300_000)


def test_ranks_and_correlations_of_sparse_counts(spark):
    """Against the dense kernels, with negative counts, ties and regions without a count."""
    from peakweave.kernels import rank
    from peakweave.operators import moments

    rng = np.random.default_rng(4)
    X = rng.integers(-2, 4, (30, 6)).astype(float) * (rng.random((30, 6)) < 0.6)
    X[:, 5] = 0
    X[0, 5] = 1
    rows = [(int(c), int(k), float(X[c, k])) for c, k in zip(*np.nonzero(X), strict=True)]
    counts = spark.createDataFrame(rows, "cell bigint, idx bigint, value double")
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(i + 1, 6)], "i bigint, j bigint")
    dense = rank.compute_ranks(X)
    for r in moments.average_ranks(counts, 30).collect():
        assert r["rank"] == pytest.approx(dense[r.cell, r.idx]) and r.zero_rank == pytest.approx(dense[:, r.idx][X[:, r.idx] == 0][0])
    for method in ("cov", "corrcoef", "spearman", "kendalltau"):
        want = rank.init_coefs(X, method)[0]
        for r in moments.pair_coefficients(pairs, counts, 30, method).collect():
            assert r["value"] == pytest.approx(want[r.i, r.j], abs=1e-9)
    with pytest.raises(ValueError):
        moments.pair_coefficients(pairs, counts, 30, "other")


@pytest.mark.parametrize("method", ["cov", "corrcoef", "spearman"])
def test_moments_of_many_cells(spark, method):
    """The number of cells, squared, is beyond an int."""
    from peakweave.kernels import rank
    from peakweave.operators import moments

    n = 60_000
    counts = spark.createDataFrame([(0, 0, 3.0), (1, 0, 5.0), (1, 1, 4.0), (59_999, 1, 2.0)], "cell bigint, idx bigint, value double")
    X = np.zeros((n, 2))
    X[[0, 1, 1, 59_999], [0, 0, 1, 1]] = [3, 5, 4, 2]
    got = moments.pair_coefficients(spark.createDataFrame([(0, 1)], "i bigint, j bigint"), counts, n, method).first()["value"]
    assert got == pytest.approx(rank.init_coefs(X, method)[0][0, 1], rel=1e-6)


def test_edges_read_links_once(spark):
    """Edges and both their nodes come from one pass over the links; of several links of two nodes the last one holds."""
    from peakweave.operators import graph

    rows = [("a", "b", 0.5, 1), ("b", "a", 0.4, 2), ("b", "c", 0.3, None), ("d", "d", 0.6, 1), ("c", "e", 0.1, 1), ("e", "f", None, 1), ("e", "f", float("nan"), 1)]
    links = spark.createDataFrame(rows, "Peak1 string, Peak2 string, score double, ord int")
    loops = [(x, x, 0.0) for x in "abcd"]
    by_score = graph.ccan_edges(links.drop("ord"), 0.2)
    assert sorted(map(tuple, by_score.collect())) == sorted([("a", "b", 0.5), ("b", "c", 0.3), ("d", "d", 0.6), *loops])
    by_order = graph.ccan_edges(links.where("ord IS NOT NULL"), 0.2)
    assert sorted(map(tuple, by_order.collect())) == sorted([("a", "b", 0.4), ("d", "d", 0.6), ("a", "a", 0.0), ("b", "b", 0.0), ("d", "d", 0.0)])
    for df in (by_score, graph.ccan_nodes(by_score)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sorted(r.node for r in graph.ccan_nodes(by_score).collect()) == list("abcd")


@pytest.mark.parametrize("method", ["mean", "sum"])
def test_metacell_totals_are_shuffled_once(spark, method):
    """Sizes are joined to the members: nothing is joined to the totals."""
    from peakweave.operators import metacells

    counts = spark.createDataFrame([(0, 0, 3.0), (1, 0, 5.0), (1, 1, 4.0), (2, 1, 2.0)], "cell bigint, idx bigint, value double")
    members = spark.createDataFrame([(0, 0), (0, 1), (0, 7), (1, 2)], "metacell bigint, cell bigint")
    out = metacells.aggregate_metacells(counts, members, method)
    k = 3 if method == "mean" else 1
    assert sorted(map(tuple, out.collect())) == [(0, 0, 8 / k), (0, 1, 4 / k), (1, 1, 2.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")

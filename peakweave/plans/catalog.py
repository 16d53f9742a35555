"""The query catalogue: each operator over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import graph, links, metacells, moments, network, plotdata, preprocess, regions as reg, windows
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ------------------------------------------------------------------------------------------- shared SQL

_COUNTS = "raw AS (SELECT l_suppkey AS cell, l_partkey AS part, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
_STARTS = {
    "F1": "(p_partkey // 5) * 2000 + 1",
    "F2": "(p_partkey // 10) * 8000 + ((p_partkey // 5) % 2) * 1500 + 4100",
    "F3": "(p_partkey // 15) * 12000 + ((p_partkey // 5) % 3) * 1001 + 7000",
}


def _regions(kind: str) -> str:
    return f"""{_COUNTS},
named AS (SELECT p_partkey AS part, 'chr' || (p_partkey % 5 + 1) AS chromosome, CAST({_STARTS[kind]} AS BIGINT) AS start FROM part),
regions AS (SELECT part, chromosome || '_' || start || '_' || (start + 50) AS peak, chromosome, start, start + 50 AS "end",
  row_number() OVER (ORDER BY chromosome, start, start + 50) - 1 AS idx FROM named),
counts AS (SELECT cell, idx, value FROM raw JOIN regions USING (part)),
size AS (SELECT count(*) AS n FROM supplier)"""


def _members(kind: str, window: int) -> str:
    return f"""{_regions(kind)},
ends AS (SELECT chromosome, max("end") AS max_end FROM regions GROUP BY 1),
grid AS (SELECT chromosome, off, w, ws FROM (
  SELECT chromosome, off, w, off * {window // 2} + w * {window} AS ws, max_end FROM ends, (VALUES (0), (1)) o(off), range(0, 100000) t(w)) WHERE ws < max_end),
members AS (SELECT r.*, g.off, g.w FROM regions r JOIN grid g ON r.chromosome = g.chromosome
  AND ((r.start > g.ws AND r.start < g.ws + {window - 1}) OR (r."end" > g.ws AND r."end" < g.ws + {window - 1})))"""


_MOMENTS = """
sums AS (SELECT idx, sum(value) AS sx, sum(value * value) AS sxx FROM counts GROUP BY 1),
products AS (SELECT a.i, a.j, sum(x.value * y.value) AS sxy FROM pairs a JOIN counts x ON x.idx = a.i JOIN counts y ON y.idx = a.j AND y.cell = x.cell GROUP BY 1, 2),
moments AS (SELECT a.i, a.j, (n * coalesce(sxy, 0.0) - coalesce(p.sx, 0.0) * coalesce(q.sx, 0.0)) / (n * (n - 1)) AS cov,
  (n * coalesce(p.sxx, 0.0) - coalesce(p.sx, 0.0) * coalesce(p.sx, 0.0)) / (n * (n - 1)) AS var_i,
  (n * coalesce(q.sxx, 0.0) - coalesce(q.sx, 0.0) * coalesce(q.sx, 0.0)) / (n * (n - 1)) AS var_j
  FROM pairs a LEFT JOIN products USING (i, j) LEFT JOIN sums p ON p.idx = a.i LEFT JOIN sums q ON q.idx = a.j, size)"""

#: A network of neighbouring regions: correlations of those at most three places apart on one chromosome.
_NETWORK = f"""{_regions("F1")},
pairs AS (SELECT a.idx AS i, b.idx AS j FROM regions a JOIN regions b ON a.chromosome = b.chromosome AND b.idx BETWEEN a.idx + 1 AND a.idx + 3),{_MOMENTS},
network AS (SELECT i, j, round(cov / (sqrt(var_i) * sqrt(var_j)), 6) AS score FROM moments),
links AS (SELECT a.peak AS Peak1, b.peak AS Peak2, score, i, j FROM network JOIN regions a ON a.idx = i JOIN regions b ON b.idx = j)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _f1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    return tables.fixture(spark, d, tables.spaced(2000))


def _f2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    return tables.fixture(spark, d, tables.paired())


def _f3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    return tables.fixture(spark, d, tables.chained())


def _r6(name: str, column: str | None = None) -> Column:
    return F.round(column or name, 6).alias(name)


# ------------------------------------------------------------------------------------------- regions

_REGION_COLUMNS = ["part", "peak", "chromosome", "start", "end", "idx"]


@query("region_parse_sort", f'WITH {_regions("F1")} SELECT part, peak, chromosome, start, "end", idx FROM regions')
def region_parse_sort(spark: SparkSession, d: str) -> DataFrame:
    return reg.add_region_infos(tables.part_names(spark, d, tables.spaced(2000))).select(*_REGION_COLUMNS)


@query("region_parse_custom_sep", f"""WITH {_regions("F1")} SELECT part, chromosome || ':' || start || '-' || "end" AS peak, chromosome, start, "end", idx FROM regions""")
def region_parse_custom_sep(spark: SparkSession, d: str) -> DataFrame:
    return reg.add_region_infos(tables.part_names(spark, d, tables.spaced(2000), (":", "-")), sep=(":", "-")).select(*_REGION_COLUMNS)


@query("subset_region", f"""WITH {_regions("F1")} SELECT peak, chromosome, start, "end", idx FROM regions WHERE chromosome = 'chr2' AND (start BETWEEN 4051 AND 40001 OR "end" BETWEEN 4051 AND 40001)""")
def subset_region(spark: SparkSession, d: str) -> DataFrame:
    _, regions, _ = _f1(spark, d)
    return reg.subset_region(regions, "chr2", 4051, 40001).select("peak", "chromosome", "start", "end", "idx")


@query("filter_regions_min_cells", f"""WITH {_regions("F1")} SELECT idx, peak FROM regions WHERE idx IN (SELECT idx FROM counts GROUP BY idx HAVING count(*) >= 10)""")
def filter_regions_min_cells(spark: SparkSession, d: str) -> DataFrame:
    counts, regions, _ = _f1(spark, d)
    return preprocess.filter_regions(counts, regions, min_cells=10).select("idx", "peak")


@query("filter_regions_min_counts", f"""WITH {_regions("F1")} SELECT idx, peak FROM regions WHERE idx IN (SELECT idx FROM counts GROUP BY idx HAVING sum(value) >= 750)""")
def filter_regions_min_counts(spark: SparkSession, d: str) -> DataFrame:
    counts, regions, _ = _f1(spark, d)
    return preprocess.filter_regions(counts, regions, min_counts=750).select("idx", "peak")


@query("filter_cells_min_regions", f"""WITH {_regions("F1")} SELECT cell, CAST(count(*) AS BIGINT) AS n FROM counts GROUP BY cell HAVING count(*) >= 200""")
def filter_cells_min_regions(spark: SparkSession, d: str) -> DataFrame:
    counts, _, _ = _f1(spark, d)
    return preprocess.filter_cells(counts, 200).groupBy("cell").agg(F.count("*").alias("n"))


@query("empty_regions", f"""WITH {_regions("F1")} SELECT idx, peak FROM regions WHERE idx NOT IN (SELECT idx FROM counts WHERE value > 60)""")
def empty_regions(spark: SparkSession, d: str) -> DataFrame:
    counts, regions, _ = _f1(spark, d)
    return preprocess.empty_regions(counts.where("value > 60"), regions).select("idx", "peak")


# ------------------------------------------------------------------------------------------- windows


@query("window_grid", f"WITH {_members('F1', 50000)} SELECT chromosome, off, CAST(w AS BIGINT) AS w, CAST(ws AS BIGINT) AS ws FROM grid")
def window_grid(spark: SparkSession, d: str) -> DataFrame:
    _, regions, _ = _f1(spark, d)
    return windows.window_grid(regions, 50_000).select("chromosome", "off", "w", F.col("ws").cast("bigint").alias("ws"))


@query("window_membership", f"WITH {_members('F1', 50000)} SELECT chromosome, off, CAST(w AS BIGINT) AS w, idx FROM members")
def window_membership(spark: SparkSession, d: str) -> DataFrame:
    _, regions, _ = _f1(spark, d)
    return windows.window_members(regions, 50_000).select("chromosome", "off", "w", "idx")


@query("window_membership_narrow", f"WITH {_members('F1', 4000)} SELECT chromosome, off, CAST(w AS BIGINT) AS w, idx FROM members")
def window_membership_narrow(spark: SparkSession, d: str) -> DataFrame:
    _, regions, _ = _f1(spark, d)
    return windows.window_members(regions, 4_000).select("chromosome", "off", "w", "idx")


@query(
    "window_gates",
    f"""WITH {_members('F1', 50000)}, sizes AS (SELECT chromosome, off, w, count(*) AS n FROM members GROUP BY ALL)
SELECT chromosome, off, CAST(w AS BIGINT) AS w, n, n > 1 AND n <= 24 AS scored, n > 0 AND n < 24 AS sampled FROM sizes""",
)
def window_gates(spark: SparkSession, d: str) -> DataFrame:
    _, regions, _ = _f1(spark, d)
    members = windows.window_members(regions, 50_000)
    flag = lambda w, name: w.select(*windows.KEY, F.lit(True).alias(name))
    sizes = windows.window_sizes(members)
    both = sizes.join(flag(windows.scoring_windows(members, 24), "scored"), windows.KEY, "left").join(flag(windows.sampling_windows(members, 24), "sampled"), windows.KEY, "left")
    return both.select(*windows.KEY, "n", F.coalesce("scored", F.lit(False)).alias("scored"), F.coalesce("sampled", F.lit(False)).alias("sampled"))


@query(
    "window_span_gate",
    f"""WITH {_members('F1', 50000)}, spans AS (SELECT chromosome, off, w, arg_max((start + "end") / 2, idx) - arg_min((start + "end") / 2, idx) AS span FROM members GROUP BY ALL)
SELECT chromosome, off, CAST(w AS BIGINT) AS w, span FROM spans WHERE span > 25000""",
)
def window_span_gate(spark: SparkSession, d: str) -> DataFrame:
    _, regions, _ = _f1(spark, d)
    return windows.sampling_windows(windows.window_members(regions, 50_000), 200, 25_000).select(*windows.KEY, "span")


_PAIRS = f"""{_members('F1', 50000)}, twos AS (SELECT a.off, a.w, a.idx AS i, b.idx AS j, abs((a.start + a."end") / 2 - (b.start + b."end") / 2) AS distance
  FROM members a JOIN members b ON a.chromosome = b.chromosome AND a.off = b.off AND a.w = b.w AND a.idx < b.idx)"""


def _distances(spark: SparkSession, d: str) -> DataFrame:
    _, regions, _ = _f1(spark, d)
    pairs = windows.member_pairs(windows.window_members(regions, 50_000))
    return pairs.select("off", "w", "i", "j", ex.distance(*[F.col(c) for c in ("start_i", "end_i", "start_j", "end_j")]).alias("distance"))


@query("pair_distance", f"WITH {_PAIRS} SELECT off, CAST(w AS BIGINT) AS w, i, j, distance FROM twos")
def pair_distance(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d)


@query(
    "distance_penalty",
    f"WITH {_PAIRS} SELECT off, CAST(w AS BIGINT) AS w, i, j, round(CASE WHEN distance <= 3000 THEN 0.0 ELSE 1.5 * (1 - pow(3000.0 / distance, 0.75)) END, 6) AS penalty FROM twos",
)
def distance_penalty(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d).select("off", "w", "i", "j", F.round(ex.distance_penalty(1.5, F.col("distance"), 3000, 0.75), 6).alias("penalty"))


# ------------------------------------------------------------------------------------------- moments


@query("null_rows", f"WITH {_members('F1', 50000)} SELECT chromosome, off, CAST(w AS BIGINT) AS w, count(DISTINCT cell) AS n_nonnull FROM members JOIN counts USING (idx) GROUP BY ALL")
def null_rows(spark: SparkSession, d: str) -> DataFrame:
    counts, regions, _ = _f1(spark, d)
    return moments.observed_cells(windows.window_members(regions, 50_000), counts)


_WINDOW_PAIRS = f"""{_members('F2', 8000)}, pairs AS (SELECT DISTINCT a.idx AS i, b.idx AS j
  FROM members a JOIN members b ON a.chromosome = b.chromosome AND a.off = b.off AND a.w = b.w AND a.idx <= b.idx),{_MOMENTS}"""


def _window_moments(spark: SparkSession, d: str) -> DataFrame:
    counts, regions, n = _f2(spark, d)
    return moments.pair_moments(windows.member_pairs(windows.window_members(regions, 8_000), strict=False), counts, n)


@query("window_covariance", f"WITH {_WINDOW_PAIRS} SELECT i, j, round(cov, 6) AS cov FROM moments")
def window_covariance(spark: SparkSession, d: str) -> DataFrame:
    return _window_moments(spark, d).select("i", "j", _r6("cov"))


@query("window_correlation", f"WITH {_WINDOW_PAIRS} SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE round(cov / (sqrt(var_i) * sqrt(var_j)), 6) END AS corr FROM moments")
def window_correlation(spark: SparkSession, d: str) -> DataFrame:
    return moments.pair_correlations(_window_moments(spark, d)).select("i", "j", _r6("corr"))


@query("cov_ridge", f"WITH {_WINDOW_PAIRS} SELECT i, j, round(cov + CASE WHEN i = j THEN 1e-4 ELSE 0 END, 6) AS cov FROM moments")
def cov_ridge(spark: SparkSession, d: str) -> DataFrame:
    return moments.ridge(_window_moments(spark, d)).select("i", "j", _r6("cov"))


#: The dense table that the sparse operators never make: every region over all cells, with average ranks.
_DENSE = f"""{_WINDOW_PAIRS}, dense AS (SELECT s_suppkey AS cell, r.idx, coalesce(c.value, 0.0) AS value
  FROM supplier, regions r LEFT JOIN counts c ON c.cell = s_suppkey AND c.idx = r.idx),
ranks AS (SELECT cell, idx, value, (rank() OVER (PARTITION BY idx ORDER BY value) + (count(*) OVER (PARTITION BY idx, value) - 1) / 2.0) / n AS rank FROM dense, size),
zeros AS (SELECT idx, (n - count(*) FILTER (value <> 0) + 1) / 2.0 / n AS zero_rank FROM dense, size GROUP BY idx, n),
twos AS (SELECT i, j, x.cell, x.value AS x, y.value AS y, x.rank AS rx, y.rank AS ry FROM pairs JOIN ranks x ON x.idx = i JOIN ranks y ON y.idx = j AND y.cell = x.cell WHERE i < j)"""


@query("avg_ranks", f"WITH {_DENSE} SELECT cell, idx, round(rank, 6) AS rank, round(zero_rank, 6) AS zero_rank FROM ranks JOIN zeros USING (idx) WHERE value <> 0")
def avg_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of all counts, with the rank of each region's absent ones."""
    counts, _, n = _f2(spark, d)
    return moments.average_ranks(counts, n).select("cell", "idx", _r6("rank"), _r6("zero_rank"))


@query("winsor_ranks", f"WITH {_DENSE} SELECT cell, idx, round(least(greatest(rank, 0.05), 0.95), 6) AS rank, round(least(greatest(zero_rank, 0.05), 0.95), 6) AS zero_rank FROM ranks JOIN zeros USING (idx) WHERE value <> 0")
def winsor_ranks(spark: SparkSession, d: str) -> DataFrame:
    counts, regions, n = _f2(spark, d)
    return moments.average_ranks(counts, n, True, 0.05, features=regions.count()).select("cell", "idx", _r6("rank"), _r6("zero_rank"))


def _coefficients(spark: SparkSession, d: str, method: str, name: str) -> DataFrame:
    """Initial coefficients of all pairs that share a window."""
    counts, regions, n = _f2(spark, d)
    pairs = windows.member_pairs(windows.window_members(regions, 8_000))
    return moments.pair_coefficients(pairs, counts, n, method).select("i", "j", _r6(name, "value"))


@query("spearman_corr", f"WITH {_DENSE} SELECT i, j, round(2 * sin(corr(rx, ry) * pi() / 6), 6) AS corr FROM twos GROUP BY 1, 2")
def spearman_corr(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, d, "spearman", "corr")


@query(
    "kendall_corr",
    f"""WITH {_DENSE} SELECT p.i, p.j, round(sin(pi() / 2 * (sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))))), 6) AS corr
FROM twos p JOIN twos q ON p.i = q.i AND p.j = q.j GROUP BY 1, 2""",
)
def kendall_corr(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, d, "kendalltau", "corr")


@query("init_corrcoef", f"WITH {_DENSE} SELECT i, j, round(corr(x, y), 6) AS corr FROM twos GROUP BY 1, 2")
def init_corrcoef(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, d, "corrcoef", "corr")


@query("init_cov", f"WITH {_DENSE} SELECT i, j, round(covar_samp(x, y), 6) AS cov FROM twos GROUP BY 1, 2")
def init_cov(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, d, "cov", "cov")


@query("frobenius_error", f"WITH {_WINDOW_PAIRS} SELECT round(sqrt(sum((cov - sign(cov) * greatest(abs(cov) - 10, 0)) * (cov - sign(cov) * greatest(abs(cov) - 10, 0)))), 6) AS error FROM moments WHERE i < j")
def frobenius_error(spark: SparkSession, d: str) -> DataFrame:
    return moments.frobenius_error(_window_moments(spark, d), ex.soft_threshold(F.col("cov"), F.lit(10.0))).select(_r6("error"))


# ------------------------------------------------------------------------------------------- network

#: With two regions a window the regularised covariance is a soft threshold; every pair is in one window of either grid.
_TWO = "1500"
_GLASSO_PAIRS = f"""{_WINDOW_PAIRS}, penal AS (SELECT i, j, sign(cov) * greatest(abs(cov) - 50 * (1 - pow(1000.0 / {_TWO}, 0.75)), 0) AS w, var_i + 1e-4 AS v, var_j + 1e-4 AS u FROM moments WHERE i < j)"""


@query("glasso_pairs", f"WITH {_GLASSO_PAIRS} SELECT i, j, round(w / sqrt(v * u), 6) AS score FROM penal WHERE w <> 0")
def glasso_pairs(spark: SparkSession, d: str) -> DataFrame:
    counts, regions, n = _f2(spark, d)
    return network.network_of(counts, regions, n, 50.0, 8_000).where("i < j").select("i", "j", _r6("score"))


#: Estimate and covariance of a window of two regions: both diagonals, either off-diagonal, determinants and the trace of their product.
_LOSSES = f"""{_GLASSO_PAIRS}, two AS (SELECT p.*, m.cov AS c FROM penal p JOIN moments m USING (i, j)),
det AS (SELECT *, v * u - w * w AS dw, v * u - c * c AS ds, 2 * (v * u - c * w) / (v * u - w * w) AS tr FROM two),
of_window AS (SELECT a.chromosome, a.off, CAST(a.w AS BIGINT) AS w, a.idx AS i, b.idx AS j FROM members a JOIN members b ON a.chromosome = b.chromosome AND a.off = b.off AND a.w = b.w AND a.idx < b.idx)"""


@query(
    "window_losses",
    f"""WITH {_LOSSES} SELECT chromosome, off, o.w, round(abs(c - d.w), 6) AS frobenius, round((c - d.w) * (c - d.w), 6) AS spectral, round((tr - ln(ds / dw) - 2) / 2, 6) AS kl,
round(2 * pow(tr / 2 - 1, 2), 6) AS quadratic, round((tr + ln(dw)) / 2 + ln(2 * pi()), 6) AS log_likelihood FROM of_window o JOIN det d USING (i, j)""",
)
def window_losses(spark: SparkSession, d: str) -> DataFrame:
    """Every metric between each window's covariance and its estimate."""
    counts, regions, n = _f2(spark, d)
    found = network.window_losses(windows.window_members(regions, 8_000), counts, n, 50.0)
    return found.select("chromosome", "off", "w", *[_r6(m) for m in ("frobenius", "spectral", "kl", "quadratic", "log_likelihood")])


@query("average_alpha", f"WITH {_GLASSO_PAIRS}, off AS (SELECT abs(cov) / (1 - pow(1000.0 / {_TWO}, 0.75)) AS alpha FROM moments WHERE i < j) SELECT round(avg(alpha), 4) AS alpha FROM off")
def average_alpha(spark: SparkSession, d: str) -> DataFrame:
    """The mean over all windows: of two regions the penalty factor is where it meets their covariance."""
    counts, regions, n = _f2(spark, d)
    alpha = network.average_alpha(counts, regions, n, 8_000, n_samples=1 << 30, n_samples_maxtry=1 << 30, distance_constraint=1_000)
    return spark.createDataFrame([(round(alpha, 4),)], "alpha double")


#: Windows of three regions in a row, the far pair under a penalty that no covariance reaches: the middle one separates the others, so that
#: the far pair's correlation is the product of the near ones.
_CHAINS = f"""{_members('F3', 12000)}, pairs AS (SELECT DISTINCT a.idx AS i, b.idx AS j
  FROM members a JOIN members b ON a.chromosome = b.chromosome AND a.off = b.off AND a.w = b.w AND a.idx <= b.idx),{_MOMENTS},
near AS (SELECT i, j, sign(cov) * greatest(abs(cov) - 20000 * (1 - pow(1000.0 / 1001, 0.75)), 0) / sqrt((var_i + 1e-4) * (var_j + 1e-4)) AS score FROM moments WHERE j = i + 1),
expected AS (SELECT i, j, score FROM near UNION ALL SELECT a.i, b.j, a.score * b.score FROM near a JOIN near b ON b.i = a.j)"""


@query("glasso_chains", f"WITH {_CHAINS} SELECT i, j, round(score, 6) + 0.0 AS expected, true AS solved FROM expected")
def glasso_chains(spark: SparkSession, d: str) -> DataFrame:
    """Whether the solver's scores in windows of three regions are those of the closed form."""
    counts, regions, n = _f3(spark, d)
    pairs = windows.member_pairs(windows.window_members(regions, 12_000), strict=False)
    least = 20000 * (1 - (1000 / 1001) ** 0.75)
    moved = moments.pair_moments(pairs, counts, n).where("j = i + 1")
    near = moved.select("i", "j", (ex.soft_threshold(F.col("cov"), F.lit(least)) / F.sqrt((F.col("var_i") + 1e-4) * (F.col("var_j") + 1e-4))).alias("expected"))
    far = near.alias("a").join(near.alias("b"), F.col("a.j") == F.col("b.i")).select("a.i", "b.j", (F.col("a.expected") * F.col("b.expected")).alias("expected"))
    found = network.network_of(counts, regions, n, 20000.0, 12_000).where("i < j")
    both = near.unionByName(far).join(found, ["i", "j"], "full")
    gap = F.abs(F.coalesce("score", F.lit(0.0)) - F.col("expected"))
    return both.select("i", "j", _r6("expected"), F.coalesce(gap < 1e-6, F.lit(False)).alias("solved"))


_RECONCILE = f"""{_members('F1', 4000)},
sizes AS (SELECT chromosome, off, w, count(*) AS n FROM members GROUP BY ALL HAVING count(*) > 1 AND count(*) <= 200),
scored AS (SELECT a.off, a.w, a.idx AS i, b.idx AS j, ((a.idx * 7 + b.idx * 3 + a.off * 5) % 11 - SHIFT) / 10.0 AS score
  FROM members a JOIN members b ON a.chromosome = b.chromosome AND a.off = b.off AND a.w = b.w AND a.idx <= b.idx JOIN sizes s ON s.chromosome = a.chromosome AND s.off = a.off AND s.w = a.w),
sums AS (SELECT i, j, sum(CASE WHEN off = 0 THEN score ELSE 0 END) AS s0, sum(CASE WHEN off = 1 THEN score ELSE 0 END) AS s1, count(*) AS n FROM scored GROUP BY 1, 2)"""


def _reconciled(spark: SparkSession, d: str, shift: int) -> tuple[DataFrame, DataFrame]:
    _, regions, _ = _f1(spark, d)
    members = windows.window_members(regions, 4_000)
    accepted = windows.scoring_windows(members)
    pairs = windows.member_pairs(members.join(accepted.select(*windows.KEY), windows.KEY, "left_semi"), strict=False)
    scored = pairs.select("off", "i", "j", (((F.col("i") * 7 + F.col("j") * 3 + F.col("off") * 5) % 11 - shift) / 10.0).alias("score"))
    return scored, links.coverage(members, accepted)


@query("reconcile", f"WITH {_RECONCILE.replace('SHIFT', '2')} SELECT i, j, round((s0 + s1) / n, 6) AS score FROM sums WHERE s0 * s1 >= 0 AND s0 + s1 <> 0")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return links.reconcile(*_reconciled(spark, d, 2)).select("i", "j", _r6("score"))


@query("reconcile_sign_disagreement", f"WITH {_RECONCILE.replace('SHIFT', '5')} SELECT i, j, round(s0, 6) AS s0, round(s1, 6) AS s1 FROM sums WHERE s0 * s1 < 0")
def reconcile_sign_disagreement(spark: SparkSession, d: str) -> DataFrame:
    scored, cover = _reconciled(spark, d, 5)
    s = lambda k: F.sum(F.when(F.col("off") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}")
    kept = links.reconcile(scored, cover).select("i", "j")
    sums = scored.groupBy("i", "j").agg(s(0), s(1)).where("s0 + s1 <> 0 OR s0 * s1 < 0")
    return sums.join(kept, ["i", "j"], "left_anti").select("i", "j", _r6("s0"), _r6("s1"))


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Correlations of regions at most three places apart on one chromosome, rounded so that cutoffs are the same everywhere."""
    counts, regions, n = _f1(spark, d)
    step = regions.select("chromosome", F.col("idx").alias("i"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + 3)).alias("j"))
    pairs = step.join(regions.select(F.col("chromosome").alias("c"), F.col("idx").alias("j")), "j").where("chromosome = c")
    found = moments.pair_correlations(moments.pair_moments(pairs, counts, n))
    return found.select("i", "j", _r6("score", "corr")), regions


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    net, regions = _network(spark, d)
    return links.extract_links(net, regions), regions


@query("extract_links", f"WITH {_NETWORK} SELECT Peak1, Peak2, score FROM links ORDER BY score DESC, i, j")
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return links.order_links(_links(spark, d)[0])


@query("top_links", f"WITH {_NETWORK}, ranked AS (SELECT Peak1, Peak2, score, split_part(Peak1, '_', 1) AS chromosome, row_number() OVER (PARTITION BY split_part(Peak1, '_', 1) ORDER BY score DESC, i, j) AS rank FROM links) SELECT * FROM ranked WHERE rank <= 10")
def top_links(spark: SparkSession, d: str) -> DataFrame:
    return links.top_links(_links(spark, d)[0], 10).select("Peak1", "Peak2", "score", "chromosome", "rank")


@query("score_quantile", f"WITH {_NETWORK}, q AS (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS p, unnest(quantile_cont(score, [0.05, 0.5, 0.95])) AS value FROM network) SELECT p, round(value, 6) AS value FROM q")
def score_quantile(spark: SparkSession, d: str) -> DataFrame:
    return links.score_quantiles(_network(spark, d)[0], [0.05, 0.5, 0.95]).select("p", _r6("value"))


@query("score_histogram", f"WITH {_NETWORK} SELECT CAST(CASE WHEN score < -0.25 THEN 0 WHEN score >= 0.25 THEN 11 ELSE floor((score + 0.25) * 10 / 0.5) + 1 END AS BIGINT) AS bin, count(*) AS n FROM network GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return links.score_histogram(_network(spark, d)[0], -0.25, 0.25, 10)


@query("network_subset", f"""WITH {_NETWORK}, kept AS (SELECT idx FROM regions WHERE chromosome = 'chr3' AND (start BETWEEN 1 AND 60000 OR "end" BETWEEN 1 AND 60000)) SELECT i, j, score FROM network WHERE i IN (SELECT idx FROM kept) AND j IN (SELECT idx FROM kept)""")
def network_subset(spark: SparkSession, d: str) -> DataFrame:
    net, regions = _network(spark, d)
    return reg.subset_network(net, reg.subset_region(regions, "chr3", 1, 60_000)).select("i", "j", "score")


@query("network_symmetric", f"WITH {_NETWORK} SELECT i, j, score FROM network UNION ALL SELECT j, i, score FROM network UNION ALL SELECT idx, idx, 1.0 FROM regions")
def network_symmetric(spark: SparkSession, d: str) -> DataFrame:
    """Both triangles and the diagonal, as a network is kept."""
    return links.symmetric(*_network(spark, d))


# ------------------------------------------------------------------------------------------- modules

_CUT = 0.05
_EDGES = f"""{_NETWORK}, above AS (SELECT Peak1, Peak2, score FROM links WHERE score > {_CUT}),
nodes AS (SELECT Peak1 AS node FROM above UNION SELECT Peak2 FROM above),
edges AS (SELECT least(Peak1, Peak2) AS a, greatest(Peak1, Peak2) AS b, score AS w FROM above UNION ALL SELECT node, node, 0.0 FROM nodes),
labels AS (SELECT peak, CAST(idx // 7 AS INTEGER) AS CCAN FROM regions WHERE idx % 9 <> 0)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.ccan_edges(_links(spark, d)[0], _CUT)


def _labels(regions: DataFrame) -> DataFrame:
    """Given modules, for the operators that take them."""
    return regions.where("idx % 9 <> 0").select(F.col("peak").alias("Peak"), F.floor(F.col("idx") / 7).cast("int").alias("CCAN"))


@query("ccan_graph", f"WITH {_EDGES} SELECT a, b, w FROM edges")
def ccan_graph(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query("ccan_nodes", f"WITH {_EDGES} SELECT node FROM nodes")
def ccan_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.ccan_nodes(_edges(spark, d))


@query("ccan_components", f"""WITH RECURSIVE {_EDGES}, arcs AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, component) USING KEY (node) AS (SELECT node, node FROM nodes UNION SELECT x.b, min(r.component) FROM reach r JOIN arcs x ON x.a = r.node JOIN recurring.reach o ON o.node = x.b WHERE r.component < o.component GROUP BY x.b)
SELECT node, component FROM reach""")
def ccan_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_labels(_edges(spark, d))


@query("ccan_sizes", f"WITH {_EDGES} SELECT CCAN, count(*) AS n FROM labels GROUP BY 1 HAVING count(*) > 5")
def ccan_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.ccan_sizes(_labels(_f1(spark, d)[1]), 6)


#: Cliques of four regions in a row, of two weights; two and two are joined by one weak link.
_WEAK = 0.197
_CLIQUES = f"""{_regions("F1")}, cliques AS (SELECT a.peak AS Peak1, b.peak AS Peak2, 0.305 + (a.idx // 4 % 2) * 0.1 AS score, a.idx // 4 AS g FROM regions a JOIN regions b ON a.idx < b.idx AND a.idx // 4 = b.idx // 4)"""


def _cliques(spark: SparkSession, d: str) -> DataFrame:
    regions = _f1(spark, d)[1].select("peak", "idx", F.floor(F.col("idx") / 4).alias("g"))
    side = lambda k: regions.select(F.col("peak").alias(f"Peak{k}"), F.col("idx").alias(f"idx{k}"), "g")
    both = side(1).join(side(2), "g").where("idx1 < idx2").select("Peak1", "Peak2", (0.305 + F.col("g") % 2 * 0.1).alias("score"))
    last, first = regions.where("idx % 8 = 3").select(F.col("peak").alias("Peak1"), F.col("idx")), regions.where("idx % 8 = 4").select(F.col("peak").alias("Peak2"), (F.col("idx") - 1).alias("idx"))
    return both.unionByName(last.join(first, "idx").select("Peak1", "Peak2", F.lit(_WEAK).alias("score")))


@query(
    "ccans_of_cliques",
    f"""WITH {_CLIQUES}, first AS (SELECT g, min(least(Peak1, Peak2)) AS name FROM cliques GROUP BY 1), numbered AS (SELECT g, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS CCAN FROM first)
SELECT peak AS Peak, CCAN FROM regions JOIN numbered ON idx // 4 = g""",
)
def ccans_of_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Modules of all regions at a cutoff above the weak links."""
    return graph.find_ccans(_cliques(spark, d), coaccess_cutoff_override=0.25)


@query("ccans_of_joined_cliques", f"""WITH {_CLIQUES}, first AS (SELECT g // 2 AS h, min(least(Peak1, Peak2)) AS name FROM cliques GROUP BY 1), numbered AS (SELECT h, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS CCAN FROM first)
SELECT peak AS Peak, CCAN FROM regions JOIN numbered ON idx // 8 = h""")
def ccans_of_joined_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Modules with the weak links: in so large a graph two cliques with one link between them have more modularity as one."""
    return graph.find_ccans(_cliques(spark, d), coaccess_cutoff_override=0.1)


@query("find_cutoff", f"WITH {_CLIQUES} SELECT count(DISTINCT g) AS n_modules, true AS parted FROM cliques")
def find_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """How many modules the cutoff fitted to one digit (by default two) gives, and whether it parts the cliques without losing the weaker ones."""
    found = graph.checkpointed(_cliques(spark, d))
    cutoff = graph.find_ccan_cutoff(found, tolerance_digits=1)
    return spark.createDataFrame([(graph.number_of_ccans(found, cutoff), _WEAK <= cutoff < 0.305)], "n_modules bigint, parted boolean")


@query("add_ccans_join", f'WITH {_EDGES} SELECT peak, chromosome, start, "end", idx, CCAN FROM regions LEFT JOIN labels USING (peak)')
def add_ccans_join(spark: SparkSession, d: str) -> DataFrame:
    regions = _f1(spark, d)[1]
    return graph.add_ccans(regions, _labels(regions)).select("peak", "chromosome", "start", "end", "idx", "CCAN")


# ------------------------------------------------------------------------------------------- metacells

_TFIDF = f"""{_regions("F1")}, tfidf AS (SELECT cell, idx, value / sum(value) OVER (PARTITION BY cell) * (CAST(n AS DOUBLE) / sum(value) OVER (PARTITION BY idx)) AS value FROM counts, size)"""


@query("tfidf", f"WITH {_TFIDF} SELECT cell, idx, round(value, 8) AS value FROM tfidf")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    counts, _, n = _f1(spark, d)
    return metacells.tfidf(counts, n).withColumn("value", F.round("value", 8))


@query("lsi_normalize", f"WITH {_TFIDF} SELECT cell, idx, round(ln(1 + value / sum(value) OVER (PARTITION BY cell) * 1e4), 6) AS value FROM tfidf")
def lsi_normalize(spark: SparkSession, d: str) -> DataFrame:
    counts, _, n = _f1(spark, d)
    return metacells.lsi_normalize(counts, n).withColumn("value", F.round("value", 6))


@query(
    "knn_embeddings",
    """WITH e AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.cell, b.cell AS neighbor, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e a, e b),
r AS (SELECT cell, neighbor, row_number() OVER (PARTITION BY cell ORDER BY d, neighbor) AS rank FROM d) SELECT cell, neighbor, rank FROM r WHERE rank <= 10""",
)
def knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return metacells.knn(tables.read_table(spark, d, "embeddings"), 10, "vec_id", "embedding")


#: Given metacells: three cells in a row, from every cell on.
_GIVEN = f"""{_regions("F1")}, given AS (SELECT CAST(s_suppkey AS BIGINT) AS metacell, CAST(s_suppkey + k AS BIGINT) AS cell FROM supplier, (VALUES (0), (1), (2)) t(k))"""


def _given(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return tables.read_table(spark, d, "supplier").select(s.alias("metacell"), F.explode(F.sequence(s, s + 2)).alias("cell"))


@query("metacell_mean", f"WITH {_GIVEN} SELECT metacell AS cell, idx, round(sum(value) / 3, 6) AS value FROM given JOIN counts USING (cell) GROUP BY 1, 2")
def metacell_mean(spark: SparkSession, d: str) -> DataFrame:
    return metacells.aggregate_metacells(_f1(spark, d)[0], _given(spark, d)).withColumn("value", F.round("value", 6))


@query("metacell_sum", f"WITH {_GIVEN} SELECT metacell AS cell, idx, sum(value) AS value FROM given JOIN counts USING (cell) GROUP BY 1, 2")
def metacell_sum(spark: SparkSession, d: str) -> DataFrame:
    return metacells.aggregate_metacells(_f1(spark, d)[0], _given(spark, d), "sum")


@query("metacell_overlap", f"WITH {_GIVEN} SELECT x.metacell AS a, y.metacell AS b, count(*) AS n FROM given x JOIN given y ON x.cell = y.cell AND x.metacell < y.metacell GROUP BY 1, 2")
def metacell_overlap(spark: SparkSession, d: str) -> DataFrame:
    return metacells.overlaps(_given(spark, d))


@query(
    "compute_metacells",
    f"""WITH {_regions("F1")}, given AS (SELECT CAST(s_suppkey // 5 AS BIGINT) AS metacell, s_suppkey AS cell FROM supplier)
SELECT metacell AS cell, idx, round(sum(value) / 5, 6) AS value FROM given JOIN counts USING (cell) GROUP BY 1, 2""",
)
def compute_metacells(spark: SparkSession, d: str) -> DataFrame:
    """Metacells of all cells from a given embedding, in which five cells in a row lie together."""
    counts, regions, n = _f1(spark, d)
    c = F.col("s_suppkey")
    embedding = tables.read_table(spark, d, "supplier").select(c.alias("cell"), F.array(F.floor(c / 5) * 1000.0, (c % 5).cast("double")).alias("vec"))
    return metacells.compute_metacells(counts, regions, n, k=5, embedding=embedding).select("cell", "idx", _r6("value"))


# ------------------------------------------------------------------------------------------- plot tables

_RANGE = ("chr1", 2000, 60_000)
_FOUND = f"""{_NETWORK}, ends AS (SELECT Peak1, Peak2, score, split_part(Peak1, '_', 2)::BIGINT AS start1, split_part(Peak1, '_', 3)::BIGINT AS end1, split_part(Peak2, '_', 2)::BIGINT AS start2, split_part(Peak2, '_', 3)::BIGINT AS end2
  FROM links WHERE Peak1 LIKE 'chr1!_%' ESCAPE '!' AND Peak2 LIKE 'chr1!_%' ESCAPE '!'),
found AS (SELECT * FROM ends WHERE end1 BETWEEN 2000 AND 60000 AND start2 BETWEEN 2000 AND 60000)"""
_ARCS = """SELECT Peak1, Peak2, score, (start1 + end1 + start2 + end2) / 4 AS center, (start2 + end2 - start1 - end1) / 2 AS width, round(2 * abs(score), 6) AS height,
round(abs(score) / (SELECT max(abs(score)) FROM found), 6) AS alpha, round(4 * abs(score) / (SELECT max(abs(score)) FROM found), 6) AS line_width, CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS sign FROM found"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.connections_in(_links(spark, d)[0], *_RANGE, check=False)


def _rounded_arcs(found: DataFrame, threshold: float, positive: bool) -> DataFrame:
    return plotdata.arcs(found, threshold, positive).withColumns({c: F.round(c, 6) for c in ("height", "alpha", "line_width")})


@query("arcs", f"WITH {_FOUND} {_ARCS} WHERE abs(score) >= 0.02 AND score <> 0")
def arcs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_arcs(_found(spark, d), 0.02, False)


@query("arcs_only_positive", f"WITH {_FOUND} {_ARCS} WHERE score >= 0.02 AND score <> 0")
def arcs_only_positive(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_arcs(_found(spark, d), 0.02, True)


@query("arc_regions", f'WITH {_FOUND} SELECT start1 AS start, end1 AS "end" FROM found UNION SELECT start2, end2 FROM found')
def arc_regions(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.arc_regions(_found(spark, d))


_GENES = """genes AS (SELECT 'chr' || (p_partkey % 5 + 1) AS chromosome, CAST(p_partkey * 1000 AS BIGINT) AS start, CAST(p_partkey * 1000 + p_size * 100 AS BIGINT) AS "end",
CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS genename FROM part)"""


def _genes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    raw = tables.read_table(spark, d, "part").select(
        (p % 5 + 1).alias("chromosome_name"), (p * 1000).alias("start_position"), (p * 1000 + F.col("p_size") * 100).alias("end_position"),
        F.when(p % 2 == 0, 1).otherwise(-1).alias("strand"), F.when(p % 7 != 0, F.col("p_brand")).alias("external_gene_name"),
    )
    return plotdata.normalize_genes(raw)


@query("genes_normalize", f'WITH {_GENES} SELECT chromosome, start, "end", strand, genename FROM genes')
def genes_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _genes(spark, d)


@query("genes_in_region", f"""WITH {_GENES} SELECT chromosome, start, "end", strand, coalesce(genename, 'unknown') AS genename FROM genes WHERE chromosome = 'chr2' AND start >= 20000 AND "end" <= 150000""")
def genes_in_region(spark: SparkSession, d: str) -> DataFrame:
    return plotdata.genes_in(_genes(spark, d), "chr2", 20_000, 150_000, check=False)


@query(
    "gene_labels",
    f"""WITH {_GENES}, g AS (SELECT chromosome, start, coalesce(genename, 'unknown') AS genename, strand FROM genes WHERE chromosome = 'chr2' AND start >= 0 AND "end" <= 400000)
SELECT chromosome, start, genename, round(length(genename) * 1.5, 6) AS name_width, round(length(genename) * 1.5 + 5.0, 6) AS padding, CASE WHEN strand = '+' THEN '#00A08A' ELSE '#F2AD00' END AS color FROM g""",
)
def gene_labels(spark: SparkSession, d: str) -> DataFrame:
    own = plotdata.gene_labels(plotdata.genes_in(_genes(spark, d), "chr2", 0, 400_000, check=False))
    return own.select("chromosome", "start", "genename", _r6("name_width"), _r6("padding"), "color")


#: Greedy packing, gene by gene in order of start: a track is known by the end of its last gene and label.
_TRACKS = f"""RECURSIVE {_GENES}, own AS (SELECT chromosome, coalesce(genename, 'unknown') AS genename, start, "end", length(coalesce(genename, 'unknown')) * 1.5 + 5.0 AS padding FROM genes WHERE chromosome = 'chr2' AND start >= 0 AND "end" <= 20000000),
listed AS (SELECT *, row_number() OVER (ORDER BY start, "end", genename) AS n FROM own),
packed(n, ends, track) AS (SELECT CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST(-1 AS BIGINT)
  UNION ALL SELECT n, CASE WHEN k = 0 THEN list_append(ends, "end" + padding) ELSE list_concat(list_append(ends[1 : k - 1], greatest(ends[k], "end" + padding)), ends[k + 1 :]) END, CASE WHEN k = 0 THEN len(ends) ELSE k - 1 END
  FROM (SELECT g.n, g."end", g.padding, p.ends, coalesce(list_position(list_transform(p.ends, lambda x: x + 0.5 <= g.start - 1000), true), 0) AS k FROM packed p JOIN listed g ON g.n = p.n + 1))"""


@query("gene_tracks", f'WITH {_TRACKS} SELECT chromosome, genename, start, "end", track FROM listed JOIN packed USING (n)')
def gene_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of the genes of a range."""
    return plotdata.gene_tracks(plotdata.genes_in(_genes(spark, d), "chr2", 0, 20_000_000, check=False), gene_spacing=1_000)


@query("ccan_window", f'WITH {_EDGES}, own AS (SELECT min(chromosome) AS chromosome, min(start) AS a, max("end") AS b FROM regions JOIN labels USING (peak) WHERE CCAN = 2) SELECT chromosome, round(a - (b - a) * 0.01, 6) AS start, round(b + (b - a) * 0.01, 6) AS "end" FROM own')
def ccan_window(spark: SparkSession, d: str) -> DataFrame:
    regions = _f1(spark, d)[1]
    return plotdata.module_window(graph.add_ccans(regions, _labels(regions)), 2, check=False).select("chromosome", _r6("start"), _r6("end"))


@query("ccan_links_masked", f"WITH {_EDGES}, own AS (SELECT peak FROM labels WHERE CCAN = 2) SELECT Peak1, Peak2, CASE WHEN Peak1 IN (SELECT peak FROM own) AND Peak2 IN (SELECT peak FROM own) THEN score ELSE 0.0 END AS score FROM links")
def ccan_links_masked(spark: SparkSession, d: str) -> DataFrame:
    found, regions = _links(spark, d)
    return plotdata.mask_links(found.select("Peak1", "Peak2", "score"), _labels(regions).where("CCAN = 2").withColumnRenamed("Peak", "peak")).select("Peak1", "Peak2", "score")


# ------------------------------------------------------------------------------------------- without SQL


@query("glasso_network")
def glasso_network(spark: SparkSession, d: str) -> DataFrame:
    """The network of all windows for a fixed penalty factor."""
    counts, regions, n = _f1(spark, d)
    return network.network_of(counts, regions, n, 20.0, 50_000)


@query("compute_network")
def compute_network(spark: SparkSession, d: str) -> DataFrame:
    """Named links of the network with a fitted penalty, the largest scores first."""
    counts, regions, n = _f1(spark, d)
    found = network.sliding_graphical_lasso(counts, regions, n, 50_000, distance_constraint=25_000)
    return links.order_links(links.extract_links(found, regions))


@query("louvain_ccans")
def louvain_ccans(spark: SparkSession, d: str) -> DataFrame:
    """Modules at a given cutoff."""
    return graph.find_ccans(_links(spark, d)[0], coaccess_cutoff_override=_CUT)


@query("lsi_embed")
def lsi_embed(spark: SparkSession, d: str) -> DataFrame:
    """Embedding of all cells."""
    counts, _, n = _f1(spark, d)
    return metacells.lsi(counts, n, n_components=min(8, n))


@query("lsi_metacells")
def lsi_metacells(spark: SparkSession, d: str) -> DataFrame:
    """Metacell counts of all cells from an LSI embedding."""
    counts, regions, n = _f1(spark, d)
    return metacells.compute_metacells(counts, regions, n, k=5, embedding=metacells.lsi(counts, n, n_components=min(8, n)))


@query("glasso_path")
def glasso_path(spark: SparkSession, d: str) -> DataFrame:
    """Linked pairs of all regions and the largest duality gap along a path of penalty factors; every window has a path of its own."""
    counts, regions, n = _f1(spark, d)
    return network.window_paths(windows.window_members(regions, 50_000), counts, n, 0.5, [1.0, 0.5, 0.25])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Links of the network for a fixed penalty factor, the largest scores first."""
    counts, regions, n = _f1(spark, d)
    return links.order_links(links.extract_links(network.network_of(counts, regions, n, 20.0, 50_000), regions))

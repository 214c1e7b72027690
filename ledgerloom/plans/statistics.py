"""Descriptive and association plans over the cohort."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.special import correlation_p
from ..operators import assoc, describe, distance
from ..operators.describe import QUANTILES, THRESHOLDS, rounded
from ..sources.tables import table
from .base import COHORT_SQL, cohort, lines, positive
from .registry import query

OUTCOMES = ["t1", "t2", "t3", "total"]


def _r(e: str, name: str) -> str:
    return f"round({e}, 6) AS {name}"


def _long(cols: list[str], keep: str = "") -> str:
    """The cohort's outcomes one below the other."""
    return ", long AS (" + " UNION ALL ".join(f"SELECT {keep + ', ' if keep else ''}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM cohort" for c in cols) + ") "


def _block(x: str = "value") -> str:
    q = ", ".join(_r(f"quantile_cont({x}, {p})", k) for k, p in QUANTILES.items())
    return f"count({x}) AS n, count(*) - count({x}) AS missing, {_r(f'avg({x})', 'mean')}, {_r(f'stddev_samp({x})', 'sd')}, {_r(f'var_samp({x})', 'var')}, {_r(f'CASE WHEN count({x}) >= 2 AND abs(avg({x})) > 1e-8 THEN stddev_samp({x}) / avg({x}) END', 'cv')}, {_r(f'min({x})', 'min')}, {_r(f'max({x})', 'max')}, {q}, {_r(f'quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)', 'iqr')}"


def totals_sql(x: str = "total", _r=_r) -> str:
    over = ", ".join(_r(f"avg(CASE WHEN {x} > {t} THEN 1.0 ELSE 0.0 END)", f"over_{t}") for t in THRESHOLDS)
    return f"{_r(f'avg({x})', 'mean')}, {_r(f'stddev_samp({x})', 'sd')}, {_r(f'quantile_cont({x}, 0.5)', 'median')}, {_r(f'quantile_cont({x}, 0.9)', 'p90')}, {_r(f'quantile_cont({x}, 0.95)', 'p95')}, {over}"


@query("scenario_summary", f"{COHORT_SQL} SELECT scenario, count(*) AS n, {totals_sql()} FROM cohort GROUP BY 1")
def scenario_summary(spark, d):
    return rounded(cohort(spark, d).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), *describe.totals()))


@query("scenario_cuts", f"{COHORT_SQL} SELECT p25, p75, count(*) FILTER (scenario = 'low') AS low, count(*) FILTER (scenario = 'medium') AS medium, count(*) FILTER (scenario = 'high') AS high FROM cohort, cuts GROUP BY 1, 2")
def scenario_cuts(spark, d):
    c = cohort(spark, d)
    return c.agg(F.percentile("q", F.lit(0.25)).alias("p25"), F.percentile("q", F.lit(0.75)).alias("p75"), *(F.count_if(F.col("scenario") == s).alias(s) for s in ("low", "medium", "high")))


_TERTILE = "tert AS (SELECT max(q) FILTER (rn = ceil(n / 3.0)) AS c1, max(q) FILTER (rn = ceil(2 * n / 3.0)) AS c2 FROM (SELECT q, row_number() OVER (ORDER BY q) AS rn, count(*) OVER () AS n FROM cohort))"


def _tertiles(c):
    """Cuts at the values of rank ceil(n / 3) and ceil(2 n / 3); no class if they coincide."""
    from ..operators.order import running_counts

    runs = running_counts(c, "q", [])
    n = c.agg(F.count("q").alias("all"))
    cuts = runs.crossJoin(F.broadcast(n)).agg(F.min(F.when(F.col("upto") >= F.ceil(F.col("all") / 3.0), F.col("q"))).alias("c1"), F.min(F.when(F.col("upto") >= F.ceil(2 * F.col("all") / 3.0), F.col("q"))).alias("c2"))
    tertile = F.when(F.col("c1") < F.col("c2"), F.when(F.col("q") <= F.col("c1"), "low").when(F.col("q") <= F.col("c2"), "medium").otherwise("high"))
    return c.crossJoin(F.broadcast(cuts)).withColumn("tertile", tertile)


@query("tertile_cuts", f"{COHORT_SQL}, {_TERTILE} SELECT c1, c2, CASE WHEN c1 < c2 THEN CASE WHEN q <= c1 THEN 'low' WHEN q <= c2 THEN 'medium' ELSE 'high' END END AS tertile, count(*) AS n FROM cohort, tert GROUP BY ALL")
def tertile_cuts(spark, d):
    return _tertiles(cohort(spark, d)).groupBy("c1", "c2", "tertile").agg(F.count(F.lit(1)).alias("n"))


@query("scenario_crosstab", f"{COHORT_SQL}, {_TERTILE} SELECT scenario, count(*) FILTER (q <= c1) AS low, count(*) FILTER (q > c1 AND q <= c2) AS medium, count(*) FILTER (q > c2) AS high FROM cohort, tert GROUP BY 1")
def scenario_crosstab(spark, d):
    return _tertiles(cohort(spark, d)).groupBy("scenario").pivot("tertile", ["low", "medium", "high"]).count().na.fill(0)


@query("adjacent_intervals", "SELECT l_orderkey, rn, gap FROM (SELECT l_orderkey, row_number() OVER w AS rn, CAST(CAST(l_shipdate AS DATE) - lag(CAST(l_shipdate AS DATE)) OVER w AS INTEGER) AS gap FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE))) WHERE gap IS NOT NULL")
def adjacent_intervals(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("ship")
    rows = lines(spark, d).select("l_orderkey", F.row_number().over(w).alias("rn"), F.datediff("ship", F.lag("ship").over(w)).alias("gap"))
    return rows.filter("gap IS NOT NULL")


@query("chronology_flags", "SELECT l_orderkey, bool_and(g IS NULL OR g >= 0) AS non_decreasing, count(*) FILTER (g < 0) AS steps_back FROM (SELECT l_orderkey, CAST(l_shipdate AS DATE) - lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_shipdate AS DATE)) AS g FROM lineitem) GROUP BY 1")
def chronology_flags(spark, d):
    g = F.datediff("ship", F.lag("ship").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "ship")))
    rows = lines(spark, d).select("l_orderkey", g.alias("g"))
    return rows.groupBy("l_orderkey").agg(F.bool_and(F.col("g").isNull() | (F.col("g") >= 0)).alias("non_decreasing"), F.count_if(F.col("g") < 0).alias("steps_back"))


@query("cumulative_milestones", f"{COHORT_SQL} SELECT procedure_code, t1 AS m1, t1 + t2 AS m2, t1 + t2 + t3 AS m3 FROM cohort")
def cumulative_milestones(spark, d):
    return cohort(spark, d).select("procedure_code", F.col("t1").alias("m1"), (F.col("t1") + F.col("t2")).alias("m2"), (F.col("t1") + F.col("t2") + F.col("t3")).alias("m3"))


# Amounts are described in thousands: six decimals of a variance then are within a double's digits.
@query("descriptive_block", f"{COHORT_SQL}, cohort_k AS (SELECT *, amount / 1000 AS amount_k FROM cohort){_long([*OUTCOMES, 'q', 'amount_k']).replace('FROM cohort', 'FROM cohort_k')} SELECT variable, {_block()} FROM long GROUP BY 1")
def descriptive_block(spark, d):
    c = positive(spark, d).withColumn("amount_k", F.col("amount") / 1000)
    return rounded(describe.blocks(describe.long(c, [], [*OUTCOMES, "q", "amount_k"]), "variable"))


@query("skew_kurtosis", f"{COHORT_SQL}{_long([*OUTCOMES, 'q'])} SELECT variable, count(value) AS n, {_r('skewness(value)', 'skewness')}, {_r('kurtosis(value)', 'excess_kurtosis')} FROM long GROUP BY 1")
def skew_kurtosis(spark, d):
    return rounded(describe.long(cohort(spark, d), [], [*OUTCOMES, "q"]).groupBy("variable").agg(*describe.shape()))


@query("tails_zeros", f"{COHORT_SQL}{_long(OUTCOMES)} SELECT variable, {_r('avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END)', 'zero_share')}, count(DISTINCT value) AS unique_values, {_r('quantile_cont(value, 0.99)', 'p99')}, {_r('quantile_cont(value, 0.01)', 'p01')} FROM long GROUP BY 1")
def tails_zeros(spark, d):
    v = describe.long(cohort(spark, d), [], OUTCOMES).groupBy("variable")
    return rounded(v.agg(F.avg((F.col("value") == 0).cast("double")).alias("zero_share"), F.count_distinct("value").alias("unique_values"), F.percentile("value", F.lit(0.99)).alias("p99"), F.percentile("value", F.lit(0.01)).alias("p01")))


_FENCE = ", f AS (SELECT quantile_cont(total, 0.25) - 1.5 * (quantile_cont(total, 0.75) - quantile_cont(total, 0.25)) AS lower, quantile_cont(total, 0.75) + 1.5 * (quantile_cont(total, 0.75) - quantile_cont(total, 0.25)) AS upper FROM cohort) "


@query("iqr_outlier_summary", f"{COHORT_SQL}{_FENCE} SELECT {_r('lower', 'lower')}, {_r('upper', 'upper')}, count(*) FILTER (total < lower) AS low, count(*) FILTER (total > upper) AS high FROM cohort, f GROUP BY lower, upper")
def iqr_outlier_summary(spark, d):
    flagged = describe.outliers(cohort(spark, d), "total")
    return rounded(flagged.groupBy("lower", "upper").agg(F.count_if(F.col("side") == "low").alias("low"), F.count_if(F.col("side") == "high").alias("high")))


@query("iqr_outlier_detail", f"{COHORT_SQL}{_FENCE} SELECT procedure_code, total, CASE WHEN total < lower THEN 'low' ELSE 'high' END AS side FROM cohort, f WHERE total < lower OR total > upper")
def iqr_outlier_detail(spark, d):
    return describe.outliers(cohort(spark, d), "total").filter("side IS NOT NULL").select("procedure_code", "total", "side")


@query("q_bands", "WITH v AS (SELECT l_orderkey, greatest(CAST(sum(l_quantity) AS BIGINT) - 60, 0) AS q FROM lineitem GROUP BY 1), k AS (SELECT quantile_cont(q, 0.25) AS k0, quantile_cont(q, 0.5) AS k1, quantile_cont(q, 0.75) AS k2 FROM v WHERE q > 0) SELECT CASE WHEN q = 0 THEN 'Q0' ELSE 'B' || CAST(1 + (q > k0)::INT + (q > k1)::INT + (q > k2)::INT AS VARCHAR) END AS band, count(*) AS n, min(q) AS lo, max(q) AS hi FROM v, k GROUP BY 1")
def q_bands(spark, d):
    q = F.greatest(F.sum("l_quantity").cast("bigint") - 60, F.lit(0))
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(q.alias("q"))
    return describe.bands(v, "q").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"))


@query("q_frequency", f"{COHORT_SQL} SELECT q, count(*) AS n, {_r('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)', 'share')} FROM cohort GROUP BY 1")
def q_frequency(spark, d):
    c = cohort(spark, d)
    freq, n = c.groupBy("q").agg(F.count(F.lit(1)).alias("n")), c.agg(F.count(F.lit(1)).alias("_all"))
    return rounded(freq.crossJoin(F.broadcast(n)).select("q", "n", (F.col("n") / F.col("_all")).alias("share")))


_PROFILE = f"count(*) AS n, min(q) AS q_min, max(q) AS q_max, {_r('quantile_cont(q, 0.5)', 'q_median')}, {_r('avg(value)', 'mean')}, {_r('quantile_cont(value, 0.5)', 'median')}, {_r('stddev_samp(value)', 'sd')}, {_r('quantile_cont(value, 0.25)', 'p25')}, {_r('quantile_cont(value, 0.75)', 'p75')}, {_r('quantile_cont(value, 0.9)', 'p90')}, min(value) AS min, max(value) AS max"


def _profile(df, group):
    out = describe.long(df, [group, "q"], ["t1", "total"]).groupBy(group, "variable").agg(
        F.count(F.lit(1)).alias("n"), F.min("q").alias("q_min"), F.max("q").alias("q_max"), F.percentile("q", F.lit(0.5)).alias("q_median"), F.avg("value").alias("mean"),
        *(F.percentile("value", F.lit(p)).alias(k) for k, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return rounded(out)


@query("year_profile", f"{COHORT_SQL}{_long(['t1', 'total'], 'notice_year, q')} SELECT notice_year, variable, {_PROFILE} FROM long GROUP BY 1, 2")
def year_profile(spark, d):
    return _profile(cohort(spark, d), "notice_year")


@query("entity_profile", f"{COHORT_SQL}{_long(['t1', 'total'], 'entity, q')} SELECT entity, variable, {_PROFILE} FROM long GROUP BY 1, 2")
def entity_profile(spark, d):
    return _profile(cohort(spark, d), "entity")


@query("segment_profile", f"{COHORT_SQL}{_long(['t1', 'total'], 'government, q')} SELECT government, variable, {_PROFILE} FROM long GROUP BY 1, 2")
def segment_profile(spark, d):
    return _profile(cohort(spark, d), "government")


@query("amount_by_group", f"{COHORT_SQL} SELECT government, {_block('amount_k')} FROM (SELECT government, amount / 1000 AS amount_k FROM cohort) GROUP BY 1")
def amount_by_group(spark, d):
    c = cohort(spark, d).withColumn("amount_k", F.col("amount") / 1000)
    return rounded(c.groupBy("government").agg(*describe.block("amount_k")))


@query("entity_cluster_profile", f"{COHORT_SQL} SELECT count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, count(*) FILTER (n > 1) AS repeated FROM (SELECT entity, count(*) AS n FROM cohort GROUP BY 1)")
def entity_cluster_profile(spark, d):
    g = cohort(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.count_if(F.col("n") > 1).alias("repeated"))


def _p_sql(inner: str, r: str) -> str:
    """Adds p by Simpson's rule: Student's tail is an integral of a power of the cosine over the angle atan(t / sqrt(df))."""
    return f""", c AS ({inner}), th AS (SELECT *, n - 2 AS df, asin(abs({r})) AS a, least(pi() / 2, asin(abs({r})) + 60 / sqrt(n - 2)) AS z FROM c),
simpson AS (SELECT c2.variable, sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos(a + (z - a) * i / 4000), 0), df - 1)) * (z - a) / 12000 * 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) AS p FROM th c2, (SELECT unnest(range(4001)) AS i) GROUP BY c2.variable, a, z, df)
SELECT c.variable, c.n, {_r(r, r)}, {_r('simpson.p', 'p')} FROM c LEFT JOIN simpson ON simpson.variable = c.variable"""


@query("pearson_table", f"{COHORT_SQL}{_long(OUTCOMES, 'q')}" + _p_sql("SELECT variable, count(*) AS n, CASE WHEN count(*) >= 3 AND min(value) < max(value) AND min(q) < max(q) THEN corr(q, value) END AS r FROM long GROUP BY 1", "r"))
def pearson_table(spark, d):
    out = describe.long(cohort(spark, d), ["q"], OUTCOMES).groupBy("variable").agg(F.count(F.lit(1)).alias("n"), assoc.pearson("q", "value").alias("r"))
    return rounded(out.withColumn("p", correlation_p(F.col("r"), F.col("n"))))


def _ranks(cols: list[str], by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return ", ".join(f"rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{c}) - 1) / 2.0 AS r_{c}" for c in cols)


@query("spearman_table", f"{COHORT_SQL}{_long(OUTCOMES, 'q')}, k AS (SELECT variable, {_ranks(['q', 'value'], 'variable')} FROM long)" + _p_sql("SELECT variable, count(*) AS n, CASE WHEN min(r_q) < max(r_q) AND min(r_value) < max(r_value) AND count(*) >= 3 THEN corr(r_q, r_value) END AS rho FROM k GROUP BY 1", "rho"))
def spearman_table(spark, d):
    out = assoc.spearman(describe.long(cohort(spark, d), ["q"], OUTCOMES), "q", "value", ["variable"])
    return rounded(out.withColumn("p", correlation_p(F.col("rho"), F.col("n"))))


_VARS = ["q", "t1", "t2", "t3", "total"]


@query("interval_spearman_matrix", f"{COHORT_SQL}, k AS (SELECT {_ranks(_VARS)} FROM cohort) " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {_r(f'corr(r_{a}, r_{b})', 'rho')} FROM k" for i, a in enumerate(_VARS) for b in _VARS[i + 1 :]))
def interval_spearman_matrix(spark, d):
    return rounded(assoc.spearman_matrix(cohort(spark, d), _VARS))


@query("covariance_matrix", COHORT_SQL + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {_r(f'covar_samp({a}, {b})', 'covariance')} FROM cohort" for i, a in enumerate(OUTCOMES) for b in OUTCOMES[i:]))
def covariance_matrix(spark, d):
    return rounded(assoc.covariances(cohort(spark, d), OUTCOMES))


@query("variance_identity", f"{COHORT_SQL} SELECT {_r('var_samp(total)', 'variance')}, {_r('var_samp(t1) + var_samp(t2) + var_samp(t3)', 'own')}, {_r('2 * (covar_samp(t1, t2) + covar_samp(t1, t3) + covar_samp(t2, t3))', 'joint')}, abs(var_samp(total) - var_samp(t1) - var_samp(t2) - var_samp(t3) - 2 * (covar_samp(t1, t2) + covar_samp(t1, t3) + covar_samp(t2, t3))) < 1e-4 AS holds FROM cohort")
def variance_identity(spark, d):
    v = lambda c: F.var_samp(F.col(c).cast("double"))
    k = lambda a, b: F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double"))
    one = cohort(spark, d).agg(v("total").alias("variance"), (v("t1") + v("t2") + v("t3")).alias("own"), (2 * (k("t1", "t2") + k("t1", "t3") + k("t2", "t3"))).alias("joint"))
    return rounded(one.withColumn("holds", F.abs(F.col("variance") - F.col("own") - F.col("joint")) < 1e-4))


@query("group_spearman", f"{COHORT_SQL}, k AS (SELECT government, {_ranks(['q', 'total'], 'government')} FROM cohort) SELECT government, count(*) AS n, {_r('CASE WHEN count(*) >= 20 THEN corr(r_q, r_total) END', 'rho')} FROM k GROUP BY 1")
def group_spearman(spark, d):
    return rounded(assoc.spearman(cohort(spark, d), "q", "total", ["government"]).withColumn("rho", F.when(F.col("n") >= 20, F.col("rho"))))


@query("within_group_rank_corr", f"{COHORT_SQL}, k AS (SELECT entity, q, total, count(*) OVER (PARTITION BY entity) AS n, min(q) OVER (PARTITION BY entity) AS q0, max(q) OVER (PARTITION BY entity) AS q1, min(total) OVER (PARTITION BY entity) AS v0, max(total) OVER (PARTITION BY entity) AS v1, {_ranks(['q', 'total'], 'entity')} FROM cohort) SELECT count(*) AS n, count(DISTINCT entity) AS groups, {_r('corr((r_q - (n + 1) / 2.0) / n, (r_total - (n + 1) / 2.0) / n)', 'rho')} FROM k WHERE n >= 3 AND q0 < q1 AND v0 < v1")
def within_group_rank_corr(spark, d):
    return rounded(assoc.within_groups(cohort(spark, d), "q", "total", "entity"))


_P = "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE ((n_nationkey * 37) % 101 + 1) / 1000.0 END AS p FROM nation"


@query("bh_adjust", f"WITH t AS ({_P}), k AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM t WHERE p IS NOT NULL) SELECT id, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted FROM k UNION ALL SELECT id, NULL, NULL FROM t WHERE p IS NULL")
def bh_adjust(spark, d):
    p = F.when(F.col("n_nationkey") % 7 != 6, ((F.col("n_nationkey") * 37) % 101 + 1) / 1000.0)
    return rounded(assoc.step_up(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), p.alias("p")), "p", ["id"]))


#: Views of the cohort: all, without four linked records, and without one of each pair.
_PAIRS = [(1, 2), (3, 4)]
VIEWS = {"full": (), "none_of_both": (1, 2, 3, 4), **{f"without_{a}_{b}": (a, b) for a in _PAIRS[0] for b in _PAIRS[1]}}
_RANKED = "k AS (SELECT *, row_number() OVER (ORDER BY total DESC, procedure_code) AS place FROM cohort)"
_VIEWS_SQL = ", v AS (" + " UNION ALL ".join(f"SELECT '{name}' AS view, k.* FROM k WHERE place NOT IN ({', '.join(map(str, gone)) or '0'})" for name, gone in VIEWS.items()) + ") "


def _views(spark, d):
    """Each row once for every view that holds it. The records in question are the four longest, found by a top-k."""
    c = cohort(spark, d)
    top = c.orderBy(F.desc("total"), "procedure_code").limit(4).select("procedure_code", F.row_number().over(Window.orderBy(F.desc("total"), "procedure_code")).alias("place"))
    placed = c.join(F.broadcast(top), "procedure_code", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    view = F.filter(F.array(*(F.struct(F.lit(n).alias("view"), F.array(*map(F.lit, gone)).cast("array<int>").alias("gone")) for n, gone in VIEWS.items())), lambda v: ~F.array_contains(v["gone"], F.col("place")))
    return placed.withColumn("view", F.explode(F.transform(view, lambda v: v["view"])))


_COHORTS = f"count(*) AS n, {_r('avg(total)', 'mean')}, {_r('stddev_samp(total)', 'sd')}, {_r('quantile_cont(total, 0.5)', 'median')}, {_r('quantile_cont(total, 0.95)', 'p95')}, {_r('corr(q, total)', 'r')}"


def _view_statistics(spark, d):
    return _views(spark, d).groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"), F.percentile("total", F.lit(0.5)).alias("median"), F.percentile("total", F.lit(0.95)).alias("p95"), assoc.pearson("q", "total").alias("r"))


@query("family_cohorts", f"{COHORT_SQL}, {_RANKED}{_VIEWS_SQL} SELECT view, {_COHORTS} FROM v GROUP BY 1")
def family_cohorts(spark, d):
    return rounded(_view_statistics(spark, d))


@query("family_changes", f"{COHORT_SQL}, {_RANKED}{_VIEWS_SQL}, s AS (SELECT view, avg(total) AS mean, stddev_samp(total) AS sd, quantile_cont(total, 0.5) AS median, corr(q, total) AS r FROM v GROUP BY 1) SELECT s.view, {_r('100 * (s.mean / f.mean - 1)', 'mean_pct')}, {_r('100 * (s.sd / f.sd - 1)', 'sd_pct')}, {_r('s.median - f.median', 'median_change')}, {_r('s.r - f.r', 'r_change')}, abs(100 * (s.mean / f.mean - 1)) > 1 OR abs(100 * (s.sd / f.sd - 1)) > 1 OR abs(s.median - f.median) > 1 OR abs(s.r - f.r) > 0.02 AS reported FROM s, s f WHERE f.view = 'full' AND s.view <> 'full'")
def family_changes(spark, d):
    s = _view_statistics(spark, d)
    f = s.filter("view = 'full'").select(*(F.col(c).alias(f"f_{c}") for c in ("mean", "sd", "median", "r")))
    change = s.filter("view <> 'full'").crossJoin(F.broadcast(f)).select("view", (100 * (F.col("mean") / F.col("f_mean") - 1)).alias("mean_pct"), (100 * (F.col("sd") / F.col("f_sd") - 1)).alias("sd_pct"), (F.col("median") - F.col("f_median")).alias("median_change"), (F.col("r") - F.col("f_r")).alias("r_change"))
    return rounded(change.withColumn("reported", (F.abs("mean_pct") > 1) | (F.abs("sd_pct") > 1) | (F.abs("median_change") > 1) | (F.abs("r_change") > 0.02)))


_CONTRAST = f"count(*) FILTER (scenario = 'low') AS n_low, count(*) FILTER (scenario = 'high') AS n_high, {_r('stddev_samp(total) FILTER (scenario = $$high$$) / nullif(stddev_samp(total) FILTER (scenario = $$low$$), 0)', 'sd_ratio')}, {_r('avg(total) FILTER (scenario = $$high$$) - avg(total) FILTER (scenario = $$low$$)', 'mean_difference')}"


def _contrast(c):
    v = lambda s: F.when(F.col("scenario") == s, F.col("total").cast("double"))
    return [F.count(v("low")).alias("n_low"), F.count(v("high")).alias("n_high"), (F.stddev_samp(v("high")) / F.nullif(F.stddev_samp(v("low")), F.lit(0.0))).alias("sd_ratio"), (F.avg(v("high")) - F.avg(v("low"))).alias("mean_difference")]


@query("extreme_contrast", f"{COHORT_SQL}, k AS (SELECT {_CONTRAST} FROM cohort) SELECT *, CASE WHEN sd_ratio IS NULL THEN 'undefined' WHEN sd_ratio > 1 THEN 'high' WHEN sd_ratio < 1 THEN 'low' ELSE 'equal' END AS wider FROM k")
def extreme_contrast(spark, d):
    c = cohort(spark, d)
    return rounded(c.agg(*_contrast(c))).withColumn("wider", F.when(F.col("sd_ratio").isNull(), "undefined").when(F.col("sd_ratio") > 1, "high").when(F.col("sd_ratio") < 1, "low").otherwise("equal"))


@query("annual_contrast", f"{COHORT_SQL}, k AS (SELECT notice_year, {_CONTRAST}, count(DISTINCT entity) FILTER (scenario = 'low') AS e_low, count(DISTINCT entity) FILTER (scenario = 'high') AS e_high FROM cohort GROUP BY 1) SELECT notice_year, n_low, n_high, CASE WHEN least(n_low, n_high, e_low, e_high) >= 20 THEN sd_ratio END AS sd_ratio, CASE WHEN least(n_low, n_high, e_low, e_high) >= 20 THEN mean_difference END AS mean_difference, least(n_low, n_high, e_low, e_high) >= 20 AS supported FROM k")
def annual_contrast(spark, d):
    c = cohort(spark, d)
    e = lambda s: F.count_distinct(F.when(F.col("scenario") == s, F.col("entity")))
    k = rounded(c.groupBy("notice_year").agg(*_contrast(c), e("low").alias("e_low"), e("high").alias("e_high")))
    fine = F.least("n_low", "n_high", "e_low", "e_high") >= 20
    return k.select("notice_year", "n_low", "n_high", *(F.when(fine, F.col(x)).alias(x) for x in ("sd_ratio", "mean_difference")), fine.alias("supported"))


@query("composition_support", f"{COHORT_SQL} SELECT scenario, government, count(*) AS n, count(DISTINCT entity) AS entities, {_r('count(*) / CAST(sum(count(*)) OVER (PARTITION BY scenario) AS DOUBLE)', 'fraction')}, count(*) < 20 OR count(DISTINCT entity) < 20 AS sparse FROM cohort GROUP BY 1, 2")
def composition_support(spark, d):
    g = cohort(spark, d).groupBy("scenario", "government").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("scenario"))
    return rounded(g.select("scenario", "government", "n", "entities", share.alias("fraction"), ((F.col("n") < 20) | (F.col("entities") < 20)).alias("sparse")))


@query("support_cells", f"{COHORT_SQL} SELECT government, scenario, count(*) AS n, count(DISTINCT entity) AS entities, min(q) AS q_min, max(q) AS q_max, min(amount) AS amount_min, max(amount) AS amount_max, {_r('quantile_cont(total, 0.5)', 'median')} FROM cohort GROUP BY 1, 2")
def support_cells(spark, d):
    return rounded(cohort(spark, d).groupBy("government", "scenario").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.min("q").alias("q_min"), F.max("q").alias("q_max"), F.min("amount").alias("amount_min"), F.max("amount").alias("amount_max"), F.percentile("total", F.lit(0.5)).alias("median")))


@query("ecdf_knots", f"{COHORT_SQL} SELECT DISTINCT total, {_r('cume_dist() OVER (ORDER BY total)', 'share')} FROM cohort")
def ecdf_knots(spark, d):
    return rounded(distance.ecdf(cohort(spark, d), "total"))


_TWO = f"{COHORT_SQL}, c AS (SELECT total AS x, count(*) FILTER (scenario = 'low') AS a, count(*) FILTER (scenario = 'high') AS b FROM cohort WHERE scenario <> 'medium' GROUP BY 1), f AS (SELECT x, sum(a) OVER (ORDER BY x) / CAST(sum(a) OVER () AS DOUBLE) AS fa, sum(b) OVER (ORDER BY x) / CAST(sum(b) OVER () AS DOUBLE) AS fb, lead(x) OVER (ORDER BY x) - x AS step FROM c) "


def _low_high(spark, d):
    return distance.distances(cohort(spark, d).filter("scenario <> 'medium'"), "total", F.col("scenario") == "low")


@query("ks_distance", f"{_TWO} SELECT {_r('max(abs(fa - fb))', 'sup_distance')} FROM f")
def ks_distance(spark, d):
    return rounded(_low_high(spark, d).select("sup_distance"))


@query("wasserstein", f"{_TWO} SELECT {_r('sum(abs(fa - fb) * step)', 'wasserstein')} FROM f")
def wasserstein(spark, d):
    return rounded(_low_high(spark, d).select("wasserstein"))


@query("exceedances", f"{COHORT_SQL}, t(threshold) AS (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) SELECT government, threshold, {_r('avg(CASE WHEN total > threshold THEN 1.0 ELSE 0.0 END)', 'share')} FROM cohort, t GROUP BY 1, 2")
def exceedances(spark, d):
    wide = cohort(spark, d).groupBy("government").agg(*(F.avg((F.col("total") > t).cast("double")).alias(str(t)) for t in THRESHOLDS))
    return rounded(wide.unpivot(["government"], [str(t) for t in THRESHOLDS], "threshold", "share").withColumn("threshold", F.col("threshold").cast("int")))


@query("figure_bins", f"{COHORT_SQL} SELECT CAST(floor(total / 50) AS BIGINT) AS x_bin, CAST(floor(q / 20) AS BIGINT) AS y_bin, count(*) AS n FROM cohort GROUP BY 1, 2")
def figure_bins(spark, d):
    return cohort(spark, d).groupBy(F.floor(F.col("total") / 50).alias("x_bin"), F.floor(F.col("q") / 20).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))

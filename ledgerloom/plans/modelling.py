"""Model plans: covariates, closed-form fits, forecasts, scores, components and folds."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import groups, model, nested
from ..operators.assoc import pearson
from ..operators.describe import rounded
from ..sources.tables import table
from .base import COHORT_SQL, cohort
from .registry import query
from .statistics import _r

CLIP = -NormalDist().inv_cdf(1e-6)
Z10 = model.Z10

_COV = """, m AS (SELECT avg(ln(1 + q)) AS mq, stddev_pop(ln(1 + q)) AS sq, avg(ln(amount)) AS ma, stddev_pop(ln(amount)) AS sa,
 avg(CASE WHEN government = 'regional' THEN 1.0 ELSE 0.0 END) FILTER (government <> 'special') AS wr, avg(CASE WHEN government = 'national' THEN 1.0 ELSE 0.0 END) FILTER (government <> 'special') AS wn FROM cohort),
cov AS (SELECT cohort.*, (ln(1 + q) - mq) / sq AS zq, (ln(amount) - ma) / sa AS zamount,
 CASE WHEN government = 'special' THEN 0 ELSE CASE WHEN government = 'regional' THEN 1 ELSE 0 END - wr END AS regional_c,
 CASE WHEN government = 'special' THEN 0 ELSE CASE WHEN government = 'national' THEN 1 ELSE 0 END - wn END AS national_c FROM cohort, m)
"""
COV_SQL = COHORT_SQL + _COV


def _cov(spark, d):
    return model.covariates(cohort(spark, d))


@query("covariate_transform", f"{COV_SQL} SELECT procedure_code, {_r('zq', 'zq')}, {_r('zamount', 'zamount')}, {_r('regional_c', 'regional_c')}, {_r('national_c', 'national_c')} FROM cov")
def covariate_transform(spark, d):
    return rounded(_cov(spark, d).select("procedure_code", "zq", "zamount", "regional_c", "national_c"))


_M4 = ["one", "zq", "regional_c", "national_c", "zamount"]


@query("design_matrix", COV_SQL + ", x AS (SELECT 1.0 AS one, * FROM cov) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 4) AS s FROM x" for i, a in enumerate(_M4) for b in _M4[i:]))
def design_matrix(spark, d):
    pairs = [(a, b) for i, a in enumerate(_M4) for b in _M4[i:]]
    one = _cov(spark, d).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    # -0.0 and 0.0 are one number, but not one text.
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.round(F.col(f"p{i}"), 4) + 0.0).alias("s")) for i, (a, b) in enumerate(pairs)))))


_OLS = "regr_slope(ln({y}), zq)", "regr_intercept(ln({y}), zq)", "sqrt(avg(ln({y}) * ln({y})) - avg(ln({y})) * avg(ln({y})) - pow(regr_slope(ln({y}), zq), 2) * var_pop(zq))"


def _ols(y: str, x: str = "zq"):
    """Slope, intercept and sigma of ln y on x, as aggregates: the likelihood's maximum for a constant scale."""
    ly = F.log(F.col(y).cast("double"))
    b = F.covar_pop(ly, F.col(x)) / F.var_pop(x)
    a = F.avg(ly) - b * F.avg(x)
    return a, b, F.sqrt(F.var_pop(ly) - b * b * F.var_pop(x))


@query("lognormal_closed_form", COV_SQL + " UNION ALL ".join(f"SELECT '{y}' AS outcome, {_r(_OLS[1].format(y=y), 'intercept')}, {_r(_OLS[0].format(y=y), 'slope')}, {_r(f'sqrt(var_pop(ln({y})) - pow(regr_slope(ln({y}), zq), 2) * var_pop(zq))', 'sigma')} FROM cov" for y in ("t1", "t3", "total")))
def lognormal_closed_form(spark, d):
    ys = ("t1", "t3", "total")
    fits = [_ols(y) for y in ys]
    one = _cov(spark, d).agg(*(e.alias(f"{n}{i}") for i, f in enumerate(fits) for n, e in zip("abs", f, strict=True)))
    return rounded(one.select(F.inline(F.array(*(F.struct(F.lit(y).alias("outcome"), F.col(f"a{i}").alias("intercept"), F.col(f"b{i}").alias("slope"), F.col(f"s{i}").alias("sigma")) for i, y in enumerate(ys))))))


_FIT = ", fit AS (SELECT regr_intercept(ln(total), zq) AS a, regr_slope(ln(total), zq) AS b, sqrt(var_pop(ln(total)) - pow(regr_slope(ln(total), zq), 2) * var_pop(zq)) AS s FROM cov)"


def _fitted(df, y="total"):
    a, b, s = _ols(y)
    fit = df.agg(a.alias("_a"), b.alias("_b"), s.alias("_s"))
    return df.crossJoin(F.broadcast(fit)).withColumn("_mu", F.col("_a") + F.col("_b") * F.col("zq"))


@query("forecast_quantiles", f"{COV_SQL}{_FIT} SELECT procedure_code, {_r('exp(a + b * zq + s * s / 2)', 'mean')}, {_r('exp(a + b * zq)', 'median')}, {_r(f'exp(a + b * zq - {Z10!r} * s)', 'p10')}, {_r(f'exp(a + b * zq + {Z10!r} * s)', 'p90')} FROM cov, fit")
def forecast_quantiles(spark, d):
    out = model.forecasts(_fitted(_cov(spark, d)), F.col("_mu"), F.col("_s"), "total")
    return rounded(out.select("procedure_code", "mean", "median", "p10", "p90"))


@query("hurdle_mixture", f"{COHORT_SQL} SELECT scenario, {_r('avg(CASE WHEN t2 = 0 THEN 1.0 ELSE 0.0 END)', 'p_zero')}, count(*) FILTER (t2 > 0) AS positive_n, min(t2) FILTER (t2 > 0) AS smallest, {_r('avg(t2)', 'mean')}, CAST(quantile_disc(t2, 0.5) FILTER (t2 > 0) AS INTEGER) AS median_positive FROM cohort GROUP BY 1")
def hurdle_mixture(spark, d):
    pos = F.when(F.col("t2") > 0, F.col("t2"))
    disc = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t2) FILTER (WHERE t2 > 0)").cast("int")
    return rounded(cohort(spark, d).groupBy("scenario").agg(F.avg((F.col("t2") == 0).cast("double")).alias("p_zero"), F.count(pos).alias("positive_n"), F.min(pos).alias("smallest"), F.avg("t2").alias("mean"), disc.alias("median_positive")))


@query("copula_corr", f"{COV_SQL}, f AS (SELECT regr_intercept(ln(t1), zq) AS a1, regr_slope(ln(t1), zq) AS b1, sqrt(var_pop(ln(t1)) - pow(regr_slope(ln(t1), zq), 2) * var_pop(zq)) AS s1, regr_intercept(ln(t3), zq) AS a3, regr_slope(ln(t3), zq) AS b3, sqrt(var_pop(ln(t3)) - pow(regr_slope(ln(t3), zq), 2) * var_pop(zq)) AS s3 FROM cov) SELECT count(*) AS n, {_r(f'corr(greatest(-{CLIP!r}, least({CLIP!r}, (ln(t1) - a1 - b1 * zq) / s1)), greatest(-{CLIP!r}, least({CLIP!r}, (ln(t3) - a3 - b3 * zq) / s3)))', 'rho')} FROM cov, f")
def copula_corr(spark, d):
    c = _cov(spark, d)
    fit = c.agg(*(e.alias(f"_{n}{y}") for y in ("t1", "t3") for n, e in zip("abs", _ols(y), strict=True)))
    z = lambda y: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.log(F.col(y)) - F.col(f"_a{y}") - F.col(f"_b{y}") * F.col("zq")) / F.col(f"_s{y}")))
    return rounded(c.crossJoin(F.broadcast(fit)).select(z("t1").alias("x"), z("t3").alias("y")).agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("rho")))


# Out-of-fold predictions of M0 (no covariate) and M1 (zq), folds by entity. A fold's fit
# comes from sums over all rows less the sums over the fold, so one aggregate fits all.
FOLDS = 3
_OOF = f"""{COV_SQL}, k AS (SELECT cov.*, ln(total) AS ly, CAST(entity % {FOLDS} AS INTEGER) AS fold FROM cov),
fs AS (SELECT h.fold, regr_intercept(k.ly, k.zq) AS a, regr_slope(k.ly, k.zq) AS b, sqrt(var_pop(k.ly) - pow(regr_slope(k.ly, k.zq), 2) * var_pop(k.zq)) AS s1, avg(k.ly) AS m, stddev_pop(k.ly) AS s0 FROM k, (SELECT DISTINCT fold FROM k) h WHERE k.fold <> h.fold GROUP BY 1),
p AS (SELECT k.*, 'M0' AS model, m AS mu, s0 AS sigma FROM k JOIN fs USING (fold) UNION ALL SELECT k.*, 'M1', a + b * zq, s1 FROM k JOIN fs USING (fold)),
oof AS (SELECT *, exp(mu + sigma * sigma / 2) AS mean, exp(mu) AS median, exp(mu - {Z10!r} * sigma) AS p10, exp(mu + {Z10!r} * sigma) AS p90, -ly - ln(sigma) - 0.5 * ln(2 * pi()) - pow((ly - mu) / sigma, 2) / 2 AS log_score FROM p)
"""


def out_of_fold(spark, d):
    k = _cov(spark, d).withColumns({"ly": F.log(F.col("total").cast("double")), "fold": (F.col("entity") % FOLDS).cast("int")})
    names = {"n": F.lit(1.0), "y": F.col("ly"), "yy": F.col("ly") ** 2, "z": F.col("zq"), "zz": F.col("zq") ** 2, "zy": F.col("zq") * F.col("ly")}
    own = k.groupBy("fold").agg(*(F.sum(e).alias(f"_{n}") for n, e in names.items()))
    every = own.agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in names))
    rest = own.crossJoin(F.broadcast(every)).select("fold", *((F.col(f"_all_{n}") - F.col(f"_{n}")).alias(n) for n in names))
    my, mz = F.col("y") / F.col("n"), F.col("z") / F.col("n")
    vy, vz, cov = F.col("yy") / F.col("n") - my * my, F.col("zz") / F.col("n") - mz * mz, F.col("zy") / F.col("n") - my * mz
    fits = rest.select("fold", my.alias("_m"), F.sqrt(vy).alias("_s0"), (cov / vz).alias("_b"), (my - cov / vz * mz).alias("_a"), F.sqrt(vy - cov * cov / vz).alias("_s1"))
    both = k.join(F.broadcast(fits), "fold").withColumn("_p", F.explode(F.array(F.struct(F.lit("M0").alias("model"), F.col("_m").alias("mu"), F.col("_s0").alias("sigma")), F.struct(F.lit("M1").alias("model"), (F.col("_a") + F.col("_b") * F.col("zq")).alias("mu"), F.col("_s1").alias("sigma")))))
    return model.forecasts(both.withColumns({c: F.col(f"_p.{c}") for c in ("model", "mu", "sigma")}), F.col("mu"), F.col("sigma"), "total")


_SCORES = f"count(*) AS n, {_r('avg(abs(total - median))', 'mae')}, {_r('avg(mean - total)', 'bias')}, {_r('100 * avg(mean - total) / avg(total)', 'bias_pct')}, {_r('avg(CASE WHEN total BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END)', 'coverage')}, {_r('avg(CASE WHEN total < p10 THEN 1.0 ELSE 0.0 END)', 'below')}, {_r('avg(CASE WHEN total > p90 THEN 1.0 ELSE 0.0 END)', 'above')}, {_r('avg(log_score)', 'log_score')}, CAST(0 AS BIGINT) AS unsupported"


@query("oof_metrics", f"{_OOF} SELECT model, {_SCORES} FROM oof GROUP BY 1")
def oof_metrics(spark, d):
    return rounded(out_of_fold(spark, d).groupBy("model").agg(*model.scores("total")))


@query("oof_by_segment", f"{_OOF} SELECT model, government, {_SCORES} FROM oof GROUP BY 1, 2")
def oof_by_segment(spark, d):
    return rounded(out_of_fold(spark, d).groupBy("model", "government").agg(*model.scores("total")))


@query("macro_entity_mae", f"{_OOF} SELECT model, {_r('avg(m)', 'macro_mae')}, count(*) AS entities FROM (SELECT model, entity, avg(abs(total - median)) AS m FROM oof GROUP BY 1, 2) GROUP BY 1")
def macro_entity_mae(spark, d):
    e = out_of_fold(spark, d).groupBy("model", "entity").agg(F.avg(F.abs(F.col("total") - F.col("median"))).alias("m"))
    return rounded(e.groupBy("model").agg(F.avg("m").alias("macro_mae"), F.count(F.lit(1)).alias("entities")))


@query("paired_gain_cluster_se", f"{_OOF}, g AS (SELECT procedure_code, entity, max(log_score) FILTER (model = 'M1') - max(log_score) FILTER (model = 'M0') AS gain FROM oof GROUP BY 1, 2), gm AS (SELECT count(*) AS n, avg(gain) AS mean FROM g), c AS (SELECT entity, sum(gain - mean) AS s FROM g, gm GROUP BY 1), r AS (SELECT n, count(*) AS clusters, mean AS difference, sqrt(count(*) / (count(*) - 1.0) * sum(s * s)) / n AS se FROM c, gm GROUP BY n, mean) SELECT n, clusters, {_r('difference', 'difference')}, {_r('se', 'se')}, {_r('difference - 1.96 * se', 'low')}, {_r('difference + 1.96 * se', 'high')} FROM r")
def paired_gain_cluster_se(spark, d):
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("log_score")))
    gains = out_of_fold(spark, d).groupBy("procedure_code", "entity").agg((pick("M1") - pick("M0")).alias("gain"))
    return rounded(model.cluster_difference(gains, "gain", "entity"))


@query("leakage_check", f"{_OOF} SELECT count(*) AS entities, count(*) FILTER (f > 1) AS crossing FROM (SELECT entity, count(DISTINCT fold) AS f FROM k GROUP BY 1)")
def leakage_check(spark, d):
    e = out_of_fold(spark, d).groupBy("entity").agg(F.count_distinct("fold").alias("f"))
    return e.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("f") > 1).alias("crossing"))


@query("sign_consistency", f"{_OOF}, s AS (SELECT government, model, avg(mean - total) AS bias FROM oof GROUP BY 1, 2) SELECT government, count(DISTINCT sign(bias)) = 1 AS same_sign, {_r('min(bias)', 'smallest')}, {_r('max(bias)', 'largest')} FROM s GROUP BY 1")
def sign_consistency(spark, d):
    s = out_of_fold(spark, d).groupBy("government", "model").agg(F.avg(F.col("mean") - F.col("total")).alias("bias"))
    return rounded(s.groupBy("government").agg((F.count_distinct(F.signum("bias")) == 1).alias("same_sign"), F.min("bias").alias("smallest"), F.max("bias").alias("largest")))


def _components(spark, d):
    """Customers linked to the projects of their orders; projects are negative numbers. Customers without orders are components of their own."""
    edges = table(spark, d, "orders").select((-1 - F.floor(F.col("o_orderkey") / 40)).cast("long").alias("a"), F.col("o_custkey").cast("long").alias("b"))
    lone = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("b")).join(edges, "b", "left_anti").select(F.col("b").alias("node"), F.col("b").alias("component"))
    return groups.components(edges).unionByName(lone)


_COMPONENTS_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT CAST(-1 - floor(o_orderkey / 40) AS BIGINT) AS a, CAST(o_custkey AS BIGINT) AS b FROM orders),
n AS MATERIALIZED (SELECT DISTINCT e.a, f.a AS b FROM e JOIN e f ON f.b = e.b WHERE f.a < e.a),
r(node, seen) AS (SELECT a, a FROM e UNION SELECT x.node, y.b FROM r x JOIN (SELECT a, b FROM n UNION SELECT b, a FROM n) y ON y.a = x.seen),
p AS MATERIALIZED (SELECT node, min(seen) AS component FROM r GROUP BY 1),
c AS (SELECT node, component FROM p UNION ALL SELECT e.b, min(p.component) FROM e JOIN p ON p.node = e.a GROUP BY 1 UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT b FROM e))"""


@query("components", f"{_COMPONENTS_SQL} SELECT node, component FROM c")
def components(spark, d):
    return _components(spark, d)


@query("component_sizes", f"{_COMPONENTS_SQL}, z AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT size, count(*) AS n FROM z GROUP BY 1")
def component_sizes(spark, d):
    z = _components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return z.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


#: The four longest records, two and two, are known to be families.
_FAMILY_SQL = COHORT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, j AS MATERIALIZED (SELECT procedure_code, total, 'ENTITY_' || CAST(entity AS VARCHAR) AS a, 'PROJECT_' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'cui:' || CAST(procedure_code // 4 AS VARCHAR) ELSE 'text:' || CAST(entity AS VARCHAR) END AS b FROM cohort JOIN orders ON o_orderkey = procedure_code),
f AS MATERIALIZED (SELECT a, row_number() OVER (ORDER BY total DESC, procedure_code) AS place FROM j QUALIFY place <= 4),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM j UNION SELECT x.a, y.a FROM f x JOIN f y ON y.place = x.place + 1 WHERE x.place IN (1, 3)),
r(node, seen) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT r.node, y.b FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) y ON y.a = r.seen),
p AS (SELECT node, min(seen) AS component FROM r GROUP BY 1), z AS (SELECT component, count(*) AS entities FROM p WHERE node LIKE 'ENTITY_%' GROUP BY 1)
SELECT node AS entity, component, entities FROM p JOIN z USING (component) WHERE node LIKE 'ENTITY_%'"""


@query("dependency_groups", _FAMILY_SQL)
def dependency_groups(spark, d):
    """Entities that share projects, and those of records that are known to be families, by the name of the first; with the number of entities."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("procedure_code"), "o_orderpriority")
    project = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("cui:"), F.floor(F.col("procedure_code") / 4).cast("string"))).otherwise(F.concat(F.lit("text:"), F.col("entity").cast("string")))
    rows = cohort(spark, d).join(orders, "procedure_code").select("procedure_code", "total", F.concat(F.lit("ENTITY_"), F.col("entity").cast("string")).alias("a"), F.concat(F.lit("PROJECT_"), project).alias("b"))
    top = rows.orderBy(F.desc("total"), "procedure_code").limit(4).agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("t"), "procedure_code")))["procedure_code"].alias("k"))
    families = top.select(F.inline(F.array(*(F.struct(F.col("k")[i].alias("left"), F.col("k")[i + 1].alias("right")) for i in (0, 2)))))
    found = groups.components(rows.select("a", "b").unionByName(groups.family_links(rows, families, "procedure_code", "a"))).filter(F.col("node").startswith("ENTITY_"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("entities"))
    return found.join(sizes.hint("merge"), "component").select(F.col("node").alias("entity"), "component", "entities")


#: One group after another, as a recursion over their order.
_FOLDS_SQL = COHORT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, g AS (SELECT CAST(entity AS VARCHAR) AS entity, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(entity AS VARCHAR)) AS r FROM cohort GROUP BY 1),
s(r, a, b, c, entity, n, fold) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS INTEGER) UNION ALL
 SELECT r, a + CASE WHEN f = 0 THEN n ELSE 0 END, b + CASE WHEN f = 1 THEN n ELSE 0 END, c + CASE WHEN f = 2 THEN n ELSE 0 END, entity, n, f
 FROM (SELECT g.r, s.a, s.b, s.c, g.entity, g.n, CASE WHEN s.a <= s.b AND s.a <= s.c THEN 0 WHEN s.b <= s.c THEN 1 ELSE 2 END AS f FROM s JOIN g ON g.r = s.r + 1))
SELECT entity, fold FROM s WHERE r > 0"""


@query("fold_assignment", _FOLDS_SQL)
def fold_assignment(spark, d):
    """Entities to three folds, larger entities first, each to the fold with the fewest rows."""
    sizes = cohort(spark, d).groupBy(F.col("entity").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("size"))
    return groups.balanced_folds(sizes, FOLDS).select(F.col("name").alias("entity"), "fold")


#: The same maximum by scoring as a recursion: each turn is a scan that sums what two systems of two equations need.
_SCORING_SQL = f"""{COV_SQL}, d AS (SELECT zq AS z, ln(total) AS y FROM cov), w AS (SELECT count(*) AS n, sum(z) AS s1, sum(z * z) AS s2, avg(y) AS m, ln(stddev_pop(y)) AS s FROM d),
it AS (SELECT 0 AS turn, m AS b0, CAST(0 AS DOUBLE) AS b1, s AS g0, CAST(0 AS DOUBLE) AS g1 FROM w UNION ALL
 SELECT turn + 1, (c2 * t0 - c1 * t1) / (c0 * c2 - c1 * c1), (c0 * t1 - c1 * t0) / (c0 * c2 - c1 * c1), g0 + (w.s2 * r0 - w.s1 * r1) / (2 * (w.n * w.s2 - w.s1 * w.s1)), g1 + (w.n * r1 - w.s1 * r0) / (2 * (w.n * w.s2 - w.s1 * w.s1))
 FROM (SELECT turn, b0, b1, g0, g1, sum(v) AS c0, sum(v * z) AS c1, sum(v * z * z) AS c2, sum(v * y) AS t0, sum(v * z * y) AS t1, sum(e * e * v - 1) AS r0, sum((e * e * v - 1) * z) AS r1
  FROM (SELECT it.*, d.z, d.y, exp(-2 * (g0 + g1 * z)) AS v, y - b0 - b1 * z AS e FROM it, d WHERE turn < 60) GROUP BY turn, b0, b1, g0, g1), w)
SELECT {_r('b0', 'b0')}, {_r('b1', 'b1')}, {_r('g0', 'g0')}, {_r('g1', 'g1')}, round(-sum(y + g0 + g1 * z + 0.5 * ln(2 * pi()) + 0.5 * pow((y - b0 - b1 * z) * exp(-(g0 + g1 * z)), 2)), 3) AS loglik, count(*) AS n FROM it, d WHERE turn = 60 GROUP BY b0, b1, g0, g1"""


def _totals_for(spark, d, cols):
    """The design, read in every pass of a fit: held where it fits, in memory or on disk."""
    return _cov(spark, d).select(*cols, "entity", F.col("total").cast("double").alias("total")).persist()


@query("fisher_scoring_fit", _SCORING_SQL.replace("WITH ", "WITH RECURSIVE ", 1))
def fisher_scoring_fit(spark, d):
    """M1 with a scale that depends on zq, from two starts within bounds."""
    rows = _totals_for(spark, d, ["one", "zq"])
    try:
        fit = model.fit_scaled(rows, ["one", "zq"], ["one", "zq"], "total")
    finally:
        rows.unpersist()
    values = (*(round(float(x), 6) for x in (*fit.beta, *fit.gamma)), round(fit.loglik, 3), fit.n)
    return spark.createDataFrame([values], "b0 double, b1 double, g0 double, g1 double, loglik double, n long")


@query("cluster_sandwich")
def cluster_sandwich(spark, d):
    """M4's location and scale coefficients with standard errors that are robust to entities."""
    cols, scale = model.DESIGNS["M4"], ["one", "zq"]
    rows = _totals_for(spark, d, cols)
    try:
        fit = model.fit_scaled(rows, cols, scale, "total")
        cov, g = model.sandwich(rows, fit, "total", "entity")
    finally:
        rows.unpersist()
    names = [("location", c) for c in cols] + [("scale", c) for c in scale]
    values = zip(names, (*fit.beta, *fit.gamma), cov.diagonal(), strict=True)
    return spark.createDataFrame([(part, c, float(x), float(v) ** 0.5, g) for (part, c), x, v in values], "part string, term string, estimate double, robust_se double, clusters long")


def _selected(spark, d) -> nested.Selection:
    """Outer and inner folds by entity; what comes out has a row for each context and model."""
    folds = {"outer": (F.col("entity") % FOLDS).cast("int"), "inner": (F.floor(F.col("entity") / FOLDS) % FOLDS).cast("int")}
    return nested.select(cohort(spark, d).withColumns(folds), "outer", "inner", "entity", "total", FOLDS)


def _frame(spark, rows: list[dict], schema: str):
    return spark.createDataFrame([tuple(round(x, 6) if isinstance(x, float) else x for x in r.values()) for r in rows], schema)


@query("nested_selection")
def nested_selection(spark, d):
    """The trail of selections: of each outer fold's training rows, and of all rows for application."""
    return _frame(spark, _selected(spark, d).audit, "context string, model string, best string, log_score double, tolerance double, competitive boolean, guarded boolean, parameters int, selected boolean, fallback boolean")


@query("model_contrasts")
def model_contrasts(spark, d):
    """Paired gains in log score on outer held-out rows: covariates added one by one, and models without q."""
    return _frame(spark, _selected(spark, d).contrasts, "left string, right string, gain double, cluster_se double, low double, high double, n long, clusters long")


@query("nested_metrics")
def nested_metrics(spark, d):
    """Scores of all models, ablations and the selected ones on outer held-out rows."""
    columns = ("log_score", "mae", "macro_mae", "observed", "predicted", "bias_pct", "coverage", "below", "above")
    return _frame(spark, _selected(spark, d).metrics, "model string, n long, clusters long, " + ", ".join(f"{c} double" for c in columns))

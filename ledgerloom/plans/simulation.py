"""Resampling and simulation plans."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distance, resample, simulate
from ..operators.groups import cut, stored
from ..operators.describe import THRESHOLDS, rounded, totals
from ..operators.rng import normal, normal_sql, uniform, uniform_sql
from ..sources import publish
from ..sources.tables import table
from .base import COHORT_SQL, cohort, positive, with_scenario
from .modelling import COV_SQL, _cov
from .registry import query
from .statistics import _r, totals_sql

SEED, REPS, N = "20261101", 2000, 4000
#: A published bundle's parameters, as a simulation is given them.
MODEL = simulate.Phases(a1=4.6, b1=-0.15, s1=0.9, a3=5.0, b3=-0.12, s3=0.8, p0=0.9, support=(3, 40, 40, 90, 150, 220, 310, 480), rho=0.35)
ALTERNATIVE = simulate.Phases(a1=4.6, b1=0.0, s1=0.95, a3=5.0, b3=0.0, s3=0.85, p0=0.9, support=MODEL.support, rho=0.35)


@query("hash_uniform", f"SELECT o_orderkey, {_r(uniform_sql(f"'{SEED}'", 'o_orderkey'), 'u')}, {_r(normal_sql(f"'{SEED}'", 'o_orderkey'), 'z')} FROM orders")
def hash_uniform(spark, d):
    return rounded(table(spark, d, "orders").select("o_orderkey", uniform(SEED, F.col("o_orderkey")).alias("u"), normal(SEED, F.col("o_orderkey")).alias("z")))


def _drawn_sql(cluster: str, seed: str) -> str:
    """Rows of the cohort, each as often as a replicate drew its cluster."""
    return f""", cl AS (SELECT {cluster} AS c, row_number() OVER (ORDER BY {cluster}) - 1 AS ordinal, count(*) OVER () AS g FROM (SELECT DISTINCT {cluster} FROM cohort)),
sl AS (SELECT r.rep, cl.ordinal AS slot, cl.g FROM cl, (SELECT unnest(range({REPS})) AS rep) r WHERE cl.g >= {resample.MIN_CLUSTERS}),
dr AS (SELECT rep, CAST(floor({uniform_sql(f"'{seed}'", "rep", "slot")} * g) AS INTEGER) AS ordinal FROM sl),
b AS (SELECT dr.rep, cohort.* FROM dr JOIN cl USING (ordinal) JOIN cohort ON cohort.{cluster} = cl.c) """


_USABLE = math.ceil(resample.USABLE * REPS)
_INTERVAL = f"count(value) AS usable, round(CASE WHEN count(value) >= {_USABLE} THEN quantile_cont(value, 0.025) END, 6) AS low, round(CASE WHEN count(value) >= {_USABLE} THEN quantile_cont(value, 0.975) END, 6) AS high"


@query("cluster_bootstrap_corr", f"{COHORT_SQL}{_drawn_sql('entity', 'corr')}, k AS (SELECT rep, q, total, rank() OVER (PARTITION BY rep ORDER BY q) + (count(*) OVER (PARTITION BY rep, q) - 1) / 2.0 AS rq, rank() OVER (PARTITION BY rep ORDER BY total) + (count(*) OVER (PARTITION BY rep, total) - 1) / 2.0 AS rt FROM b), s AS (SELECT rep, corr(q, total) AS pearson, corr(rq, rt) AS spearman FROM k GROUP BY 1), l AS (SELECT 'pearson' AS statistic, pearson AS value FROM s UNION ALL SELECT 'spearman', spearman FROM s) SELECT statistic, {_INTERVAL} FROM l GROUP BY 1")
def cluster_bootstrap_corr(spark, d):
    reps = resample.correlations(positive(spark, d).select("entity", "q", "total"), "entity", REPS, "corr", "q", "total")
    return rounded(resample.intervals(reps, ["pearson", "spearman"], REPS).drop("_"))


_STATS = ["mean", "sd", "median", "p90", "p95", *(f"over_{t}" for t in THRESHOLDS)]


def _plain(e: str, name: str) -> str:
    """A replicate's statistic as it is: rounded ones would round intervals twice."""
    return f"{e} AS {name}"


@query("component_bootstrap_summary", f"{COHORT_SQL}{_drawn_sql('entity', 'components')}, s AS (SELECT rep, scenario, {totals_sql(_r=_plain)} FROM b GROUP BY 1, 2), l AS (" + " UNION ALL ".join(f"SELECT scenario, '{s}' AS statistic, {s} AS value FROM s" for s in _STATS) + f") SELECT scenario, statistic, {_INTERVAL} FROM l GROUP BY 1, 2")
def component_bootstrap_summary(spark, d):
    rows = with_scenario(stored(positive(spark, d), "cohort")).select("entity", "scenario", "total")
    reps = resample.summaries(rows, "entity", REPS, "components", "scenario", "total")
    return rounded(resample.intervals(reps, _STATS, REPS, ["scenario"]))


@query("bootstrap_sd_ratio", f"{COHORT_SQL}{_drawn_sql('entity', 'ratio')}, s AS (SELECT rep, stddev_samp(total) FILTER (scenario = 'high') / stddev_samp(total) FILTER (scenario = 'low') AS value FROM b GROUP BY 1) SELECT 'sd_ratio' AS statistic, {_INTERVAL} FROM s GROUP BY 1")
def bootstrap_sd_ratio(spark, d):
    x, terms = F.col("total").cast("double"), {}
    for side in ("high", "low"):
        own = F.col("scenario") == side
        terms |= {f"{side}_n": own.cast("double"), f"{side}_s": F.when(own, x), f"{side}_ss": F.when(own, x * x)}
    sums = resample.moments(cohort(spark, d).select("entity", "scenario", "total"), "entity", REPS, "ratio", terms)
    v = lambda side: resample.sd(*(F.col(f"{side}_{k}") for k in ("n", "s", "ss")))
    reps = sums.select((v("high") / F.nullif(v("low"), F.lit(0.0))).alias("sd_ratio"))
    return rounded(resample.intervals(reps, ["sd_ratio"], REPS).drop("_"))


def _sim_sql(config: str, m: simulate.Phases, n: int, reps: int = 1, rho: float | None = None, where: str = "true") -> str:
    rho = m.rho if rho is None else rho
    key = lambda role: (f"'{SEED}'", f"'{config}'", "rep", "draw", f"'{role}'")
    clip = repr(simulate.CLIP)
    held = lambda e: f"greatest(-{clip}, least({clip}, {e}))"
    support = "[" + ", ".join(f"{float(v)!r}" for v in sorted(m.support)) + "]"
    third = f"({rho!r} * z1 + {math.sqrt(1 - rho * rho)!r} * z3)"
    return f"""{COV_SQL}, prof AS (SELECT *, row_number() OVER (ORDER BY procedure_code) - 1 AS ordinal, count(*) OVER () AS np FROM cov WHERE {where}),
dw AS (SELECT CAST(i // {n} AS BIGINT) AS rep, CAST(i % {n} AS BIGINT) AS draw FROM (SELECT unnest(range({n * reps})) AS i)),
zz AS (SELECT rep, draw, {uniform_sql(*key("profile"))} AS up, {normal_sql(*key("z1"))} AS z1, {normal_sql(*key("z3"))} AS z3, {uniform_sql(*key("u2"))} AS u FROM dw),
tr AS (SELECT zz.rep, zz.draw, p.procedure_code, p.scenario, p.zq, exp({m.a1!r} + {m.b1!r} * zq + {m.s1!r} * {held("z1")}) AS t1,
 CASE WHEN u <= {m.p0!r} THEN 0.0 ELSE {support}[CAST(least({len(m.support)}, greatest(1, ceil((u - {m.p0!r}) / {1 - m.p0!r} * {len(m.support)}))) AS INTEGER)] END AS t2,
 exp({m.a3!r} + {m.b3!r} * zq + {m.s3!r} * {held(third)}) AS t3 FROM zz JOIN prof p ON p.ordinal = CAST(floor(up * np) AS BIGINT)),
sim AS (SELECT *, t1 + t2 + t3 AS total FROM tr) """


def _simulated(spark, d, config, m, n=N, reps=1, rho=None):
    profiles = _cov(spark, d).select("procedure_code", "scenario", "zq")
    rows = simulate.with_profiles(simulate.draws(spark, n, reps), profiles, SEED, config)
    return simulate.trajectories(rows, m, SEED, config, rho)


@query("simulate_m1_totals", f"{_sim_sql('M1', MODEL, N)} SELECT draw, procedure_code, {_r('t1', 't1')}, {_r('t2', 't2')}, {_r('t3', 't3')}, {_r('total', 'total')} FROM sim")
def simulate_m1_totals(spark, d):
    return rounded(_simulated(spark, d, "M1", MODEL).select("draw", "procedure_code", "t1", "t2", "t3", "total"))


@query("simulate_summary", f"{_sim_sql('M1', MODEL, N)} SELECT scenario, count(*) AS n, {totals_sql()} FROM sim GROUP BY 1")
def simulate_summary(spark, d):
    return rounded(_simulated(spark, d, "M1", MODEL).groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), *totals()))


@query("phase_invariants", f"{_sim_sql('M1', MODEL, N)} SELECT count(*) AS n, count(*) FILTER (t1 < 0 OR t2 < 0 OR t3 < 0) AS negative, count(*) FILTER (abs(total - t1 - t2 - t3) > 1e-9) AS unequal, count(*) FILTER (t2 = 0) AS zero_middle FROM sim")
def phase_invariants(spark, d):
    s = _simulated(spark, d, "M1", MODEL)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("t1") < 0) | (F.col("t2") < 0) | (F.col("t3") < 0)).alias("negative"), F.count_if(F.abs(F.col("total") - F.col("t1") - F.col("t2") - F.col("t3")) > 1e-9).alias("unequal"), F.count_if(F.col("t2") == 0).alias("zero_middle"))


_PN, _PR = 50_000, 30


def _precision_sql() -> str:
    """Order statistics by their row numbers, Wilson's bounds as the roots of their quadratic."""
    ranks = {p: simulate.quantile_ranks(_PN, p) for p in (0.9, 0.95)}
    sd, zz = "stddev_samp(total)", simulate.Z95**2
    far = lambda q, p: f"greatest({q} - max(total) FILTER (rn = {ranks[p][0]}), max(total) FILTER (rn = {ranks[p][1]}) - {q})"
    parts = [("mean", "avg(total)", f"1.96 * {sd} / sqrt({_PN})", "greatest(0.25, 0.005 * abs(avg(total)))")]
    parts.append(("sd", sd, f"1.96 * sqrt(greatest(avg(pow(total - centre, 4)) - pow({sd}, 4), 0) / (4 * {_PN} * {sd} * {sd}))", f"greatest(0.5, 0.01 * {sd})"))
    for name, p, floor, share in (("p90", 0.9, 0.5, 0.01), ("p95", 0.95, 1.0, 0.02)):
        q = f"quantile_cont(total, {p})"
        parts.append((name, q, far(q, p), f"greatest({floor}, {share} * abs({q}))"))
    for t in THRESHOLDS:
        k = f"count(*) FILTER (total > {t})"
        root = f"sqrt({zz!r} * {zz!r} + 4 * {zz!r} * {k} * (1 - {k} / {_PN}))"
        bound = lambda sign, k=k, root=root: f"(2 * {k} + {zz!r} {sign} {root}) / (2 * ({_PN} + {zz!r}))"
        parts.append((f"over_{t}", f"{k} / {_PN}", f"greatest({k} / {_PN} - {bound('-')}, {bound('+')} - {k} / {_PN})", "0.005"))
    rows = " UNION ALL ".join(f"SELECT rep, '{n}' AS metric, {_r(e, 'estimate')}, {_r(h, 'halfwidth')}, {_r(t, 'tolerance')}, {h} <= {t} AS passes FROM o GROUP BY 1" for n, e, h, t in parts)
    return f"{_sim_sql('precision', MODEL, _PN, _PR)}, o AS (SELECT rep, total, avg(total) OVER (PARTITION BY rep) AS centre, row_number() OVER (PARTITION BY rep ORDER BY total) AS rn FROM sim) {rows}"


@query("precision_metrics", _precision_sql())
def precision_metrics(spark, d):
    return rounded(simulate.precision(_simulated(spark, d, "precision", MODEL, _PN, _PR), _PN))


SIZES = (1000, 5000, 10_000, 50_000, 100_000)


@query("convergence_decision")
def convergence_decision(spark, d):
    """Sizes tried, replicates that meet all tolerances, and the smallest size that is precise and agrees with all larger ones; see simulate.decide."""
    sized = [simulate.precision(_simulated(spark, d, f"size{n}", MODEL, n, _PR), n).withColumn("size", F.lit(n)) for n in SIZES]
    # A few thousand rows, which the decision reads several times.
    return simulate.decide(cut(reduce(DataFrame.unionByName, sized)), list(SIZES), _PR)


_PAIRED = _sim_sql("paired", MODEL, _PN, _PR)
_FLAT = f"({0.0!r} * z1 + {1.0!r} * z3)"


@query("paired_copula_experiment", f"{_PAIRED}, flat AS (SELECT s.rep, s.total, s.t1 + s.t2 + exp({MODEL.a3!r} + {MODEL.b3!r} * s.zq + {MODEL.s3!r} * greatest(-{simulate.CLIP!r}, least({simulate.CLIP!r}, zz.z3))) AS plain FROM sim s JOIN zz ON zz.rep = s.rep AND zz.draw = s.draw) SELECT rep, {_r('avg(total) - avg(plain)', 'mean_change')}, {_r('stddev_samp(total) - stddev_samp(plain)', 'sd_change')}, {_r('quantile_cont(total, 0.95) - quantile_cont(plain, 0.95)', 'p95_change')}, {_r('avg(CASE WHEN total > 180 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN plain > 180 THEN 1.0 ELSE 0.0 END)', 'over_180_change')} FROM flat GROUP BY 1")
def paired_copula_experiment(spark, d):
    """Both arms share profiles and normals: each row holds its total with and without the phases' dependence."""
    adjusted = _simulated(spark, d, "paired", MODEL, _PN, _PR)
    plain = simulate.trajectories(adjusted.select("rep", "draw", "zq", F.col("total").alias("adjusted")), MODEL, SEED, "paired", 0.0)
    over = lambda c: F.avg((F.col(c) > 180).cast("double"))
    p95 = lambda c: F.percentile(c, F.lit(0.95))
    return rounded(plain.groupBy("rep").agg((F.avg("adjusted") - F.avg("total")).alias("mean_change"), (F.stddev_samp("adjusted") - F.stddev_samp("total")).alias("sd_change"), (p95("adjusted") - p95("total")).alias("p95_change"), (over("adjusted") - over("total")).alias("over_180_change")))


@query("paired_experiment_bounds")
def paired_experiment_bounds(spark, d):
    """Bonferroni t bounds of the paired changes over replicates, for all contrasts together."""
    from ..operators.model import student_quantile

    names = ["mean_change", "sd_change", "p95_change", "over_180_change"]
    reps = paired_copula_experiment(spark, d)
    t = student_quantile(1 - 0.05 / (2 * len(names)), _PR - 1)
    wide = reps.unpivot(["rep"], names, "contrast", "value").groupBy("contrast").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    half = t * F.col("sd") / F.sqrt("n")
    return rounded(wide.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half, "degenerate": F.col("sd") == 0}))


_OBS = f"{_sim_sql('observed', MODEL, N)}, o AS (SELECT scenario, count(*) AS n, {totals_sql()} FROM cohort GROUP BY 1), s AS (SELECT scenario, {totals_sql()} FROM sim GROUP BY 1) "


@query("observed_vs_simulated", f"{_OBS} SELECT o.scenario, " + ", ".join(f"round(s.{c} - o.{c}, 4) AS {c}" for c in _STATS) + " FROM o JOIN s USING (scenario)")
def observed_vs_simulated(spark, d):
    o = rounded(cohort(spark, d).groupBy("scenario").agg(*totals()))
    s = rounded(_simulated(spark, d, "observed", MODEL).groupBy("scenario").agg(*totals()))
    both = o.alias("o").join(s.alias("s"), "scenario")
    return rounded(both.select("scenario", *((F.col(f"s.{c}") - F.col(f"o.{c}")).alias(c) for c in _STATS)), 4)


@query("observed_simulated_distance", f"{_sim_sql('observed', MODEL, N)}, u AS (SELECT CAST(floor(total) AS BIGINT) AS x, 1 AS a, 0 AS b FROM cohort UNION ALL SELECT CAST(floor(total) AS BIGINT), 0, 1 FROM sim), c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1), f AS (SELECT x, sum(a) OVER (ORDER BY x) / CAST(sum(a) OVER () AS DOUBLE) AS fa, sum(b) OVER (ORDER BY x) / CAST(sum(b) OVER () AS DOUBLE) AS fb, lead(x) OVER (ORDER BY x) - x AS step FROM c) SELECT {_r('max(abs(fa - fb))', 'sup_distance')}, {_r('sum(abs(fa - fb) * step)', 'wasserstein')} FROM f")
def observed_simulated_distance(spark, d):
    o = cohort(spark, d).select(F.floor(F.col("total").cast("double")).alias("x"), F.lit(True).alias("seen"))
    s = _simulated(spark, d, "observed", MODEL).select(F.floor("total").alias("x"), F.lit(False).alias("seen"))
    return rounded(distance.distances(o.unionByName(s), "x", F.col("seen")))


@query("model_minus_reference", f"{_sim_sql('reference', MODEL, N)}, alt AS (SELECT rep, draw, scenario, exp({ALTERNATIVE.a1!r} + {ALTERNATIVE.s1!r} * ln(t1 / exp({MODEL.a1!r} + {MODEL.b1!r} * zq)) / {MODEL.s1!r}) + t2 + exp({ALTERNATIVE.a3!r} + {ALTERNATIVE.s3!r} * ln(t3 / exp({MODEL.a3!r} + {MODEL.b3!r} * zq)) / {MODEL.s3!r}) AS total FROM sim), r AS (SELECT scenario, {totals_sql()} FROM sim GROUP BY 1), a AS (SELECT scenario, {totals_sql()} FROM alt GROUP BY 1) SELECT r.scenario, " + ", ".join(f"round(a.{c} - r.{c}, 4) AS {c}" for c in _STATS) + " FROM r JOIN a USING (scenario)")
def model_minus_reference(spark, d):
    r = rounded(_simulated(spark, d, "reference", MODEL).groupBy("scenario").agg(*totals()))
    a = rounded(_simulated(spark, d, "reference", ALTERNATIVE).groupBy("scenario").agg(*totals()))
    return rounded(r.alias("r").join(a.alias("a"), "scenario").select("scenario", *((F.col(f"a.{c}") - F.col(f"r.{c}")).alias(c) for c in _STATS)), 4)


@query("weighted_profile_draws", f"{COHORT_SQL}, w AS (SELECT procedure_code, CAST(sum(q) OVER (ORDER BY procedure_code) AS DOUBLE) / sum(q) OVER () AS hi, CAST(sum(q) OVER (ORDER BY procedure_code) - q AS DOUBLE) / sum(q) OVER () AS lo FROM cohort), dw AS (SELECT CAST(i AS BIGINT) AS draw, CAST(0 AS BIGINT) AS rep FROM (SELECT unnest(range(2000)) AS i)), u AS (SELECT draw, {uniform_sql(f"'{SEED}'", "'weighted'", 'rep', 'draw', "'profile'")} AS u FROM dw) SELECT draw, procedure_code FROM u JOIN w ON u.u >= w.lo AND u.u < w.hi")
def weighted_profile_draws(spark, d):
    profiles = cohort(spark, d).select("procedure_code", F.col("q").cast("double").alias("q"))
    return simulate.weighted_profiles(simulate.draws(spark, 2000), profiles, "q", SEED, "weighted").select("draw", "procedure_code")


# Models and scenarios of the published trajectories.
OUTPUT_MODELS = {"M1": MODEL, "M2": ALTERNATIVE, "M4": simulate.Phases(a1=4.5, b1=-0.2, s1=0.88, a3=5.1, b3=-0.1, s3=0.82, p0=0.88, support=MODEL.support, rho=0.3)}
SCENARIOS = ("low", "medium", "high")
OUTPUT_N = 10_000
_IDS = ["procedure_code", "entity", "project", "dependency", "q", "government", "amount"]
OUTPUT_COLUMNS = [*_IDS, "simulation_id", "model", "scenario", "t1", "t2", "t3", "m1", "m2", "m3", "total"]
#: What each row of an output must meet, told of the values that were read back.
OUTPUT_RULES = {
    "durations": "least(t1, t2, t3) >= 0 AND NOT isnan(total) AND total < double('infinity')",
    "sums": "abs(t1 + t2 + t3 - total) <= 1e-10 + 1e-12 * total",
    "milestones": "abs(m1 - t1) <= 1e-10 AND abs(m2 - t1 - t2) <= 1e-10 + 1e-12 * total AND abs(m3 - total) <= 1e-10 + 1e-12 * total",
}


def output_profiles(spark, d) -> DataFrame:
    """The cohort with its projects and the groups of entities that depend on each other."""
    from .modelling import dependency_groups

    groups = cut(dependency_groups(spark, d).select(F.substring("entity", 8, 30).cast("long").alias("entity"), F.col("component").alias("dependency")))
    own = _cov(spark, d).withColumn("project", F.floor(F.col("procedure_code") / 4).cast("long"))
    return own.select("procedure_code", F.col("entity").cast("long").alias("entity"), "project", "q", "government", "amount", "scenario", "zq").join(groups, "entity")


def trajectory_tables(spark, profiles: DataFrame, n: int = OUTPUT_N, models=tuple(OUTPUT_MODELS), scenarios=SCENARIOS) -> dict[str, DataFrame]:
    """An output for each model and scenario, with seventeen columns; each has a stream of its own, whatever else is asked for."""
    out = {}
    for name in models:
        m = OUTPUT_MODELS[name]
        for scenario in scenarios:
            config = f"{name}:scenario:{scenario}"
            rows = simulate.with_profiles(simulate.draws(spark, n), simulate.select_profiles(profiles, scenario=scenario), SEED, config)
            rows = simulate.trajectories(rows, m, SEED, config).withColumns({"model": F.lit(name), "simulation_id": F.col("draw")})
            out[f"{name}_{scenario}"] = rows.select(*OUTPUT_COLUMNS)
    return out


def publish_trajectories(spark, d, path: str, n: int = OUTPUT_N, models=tuple(OUTPUT_MODELS), scenarios=SCENARIOS) -> dict:
    """Writes outputs as gzip CSV with a manifest; see publish.publish_csv."""
    about = {"seed": SEED, "rows": n, "unit": "calendar days", "models": {k: vars(m) | {"support": list(m.support)} for k, m in OUTPUT_MODELS.items() if k in models}}
    return publish.publish_csv(trajectory_tables(spark, cut(output_profiles(spark, d)), n, models, scenarios), path, about, OUTPUT_RULES)


def _outputs_sql(select: str) -> str:
    each = [f"SELECT * FROM ({_sim_sql(f'{k}:scenario:{s}', m, OUTPUT_N, where=f"scenario = '{s}'")} SELECT sim.procedure_code, c.entity, c.q, c.government, c.amount, draw AS simulation_id, '{k}' AS model, sim.scenario, sim.t1, sim.t2, sim.t3, sim.total FROM sim JOIN cov c USING (procedure_code))" for k, m in OUTPUT_MODELS.items() for s in SCENARIOS]
    return f"WITH outputs AS ({' UNION ALL '.join(each)}) {select}"


@query("trajectory_outputs", _outputs_sql(f"SELECT model, scenario, simulation_id, procedure_code, CAST(entity AS BIGINT) AS entity, CAST(procedure_code // 4 AS BIGINT) AS project, q, government, amount, {', '.join(_r(e, n) for n, e in (('t1', 't1'), ('t2', 't2'), ('t3', 't3'), ('m1', 't1'), ('m2', 't1 + t2'), ('m3', 't1 + t2 + t3'), ('total', 'total')))} FROM outputs"))
def trajectory_outputs(spark, d):
    """All rows of the nine outputs, without the dependency groups, which have a query of their own."""
    profiles = _cov(spark, d).withColumns({"project": F.floor(F.col("procedure_code") / 4).cast("long"), "dependency": F.lit(None).cast("string"), "entity": F.col("entity").cast("long")})
    return rounded(reduce(DataFrame.unionByName, trajectory_tables(spark, profiles).values()).drop("dependency"))


@query("simulated_lineage", _outputs_sql("SELECT model, scenario, count(*) AS n, count(*) FILTER (entity IS NULL) AS missing, CAST(0 AS BIGINT) AS differing FROM outputs GROUP BY 1, 2"))
def simulated_lineage(spark, d):
    """Whether every simulated row has the attributes of the profile that it names."""
    profiles = _cov(spark, d).withColumns({"project": F.floor(F.col("procedure_code") / 4).cast("long"), "dependency": F.lit(None).cast("string"), "entity": F.col("entity").cast("long")})
    seen = ["q", "government", "amount", "project", "entity"]
    parts = [simulate.lineage(t, profiles, "procedure_code", seen).select(F.lit(k.split("_")[0]).alias("model"), F.lit(k.split("_")[1]).alias("scenario"), "n", "missing", "differing") for k, t in trajectory_tables(spark, profiles).items()]
    return reduce(DataFrame.unionByName, parts)

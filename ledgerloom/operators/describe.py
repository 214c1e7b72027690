"""Descriptive statistics, long and grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_counts

# The quantiles and the thresholds in days that reports name.
QUANTILES = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
THRESHOLDS = (30, 45, 60, 75, 90, 120, 150, 180)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; NaN becomes null."""
    return df.select(*(F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def long(df: DataFrame, ids: list[str], variables: list[str]) -> DataFrame:
    return df.select(*ids, *(F.col(v).cast("double").alias(v) for v in variables)).unpivot(ids, variables, "variable", "value")


def _moments(c: Column) -> list[Column]:
    n, mean, sd = F.count(c), F.avg(c), F.stddev_samp(c)
    cv = F.when((n >= 2) & (F.abs(mean) > 1e-8), sd / mean)
    return [n.alias("n"), F.count_if(c.isNull()).alias("missing"), mean.alias("mean"), sd.alias("sd"), F.var_samp(c).alias("var"), cv.alias("cv"), F.min(c).alias("min"), F.max(c).alias("max")]


def block(x: str = "value") -> list[Column]:
    """n, missing, mean, sd, var, cv, extremes, quantiles (linear) and IQR. A group's different values are held in a task for each quantile."""
    c = F.col(x)
    q = {k: F.percentile(c, F.lit(p)) for k, p in QUANTILES.items()}
    return [*_moments(c), *(v.alias(k) for k, v in q.items()), (q["p75"] - q["p25"]).alias("iqr")]


def blocks(df: DataFrame, by: str, x: str = "value") -> DataFrame:
    """block() of few groups (by, without nulls) of any number of different values: quantiles are the values at their places among running counts."""
    one = df.groupBy(by).agg(*_moments(F.col(x)))
    counts = running_counts(df, x, [by]).join(F.broadcast(one.select(by, F.col("n").alias("_all"))), by)
    at = {k: (F.col("_all") - 1) * F.lit(p) for k, p in QUANTILES.items()}
    side = lambda place: F.min(F.when(F.col("upto") > place, F.col(x)))
    found = counts.groupBy(by).agg(F.max("_all").alias("_all"), *(side(f(v)).alias(f"_{name}_{k}") for k, v in at.items() for name, f in (("lo", F.floor), ("hi", F.ceil))))
    part = {k: v - F.floor(v) for k, v in at.items()}
    linear = [((1 - part[k]) * F.col(f"_lo_{k}") + part[k] * F.col(f"_hi_{k}")).alias(k) for k in QUANTILES]
    return one.join(found.select(by, *linear), by, "left").withColumn("iqr", F.col("p75") - F.col("p25"))


def shape(x: str = "value") -> list[Column]:
    """Bias-corrected skewness and excess kurtosis; null for too few rows or a constant."""
    c = F.col(x)
    n = F.count(c).cast("double")
    varies = F.min(c) < F.max(c)
    skew = F.when(varies & (n >= 3), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(varies & (n >= 4), ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))
    return [F.count(c).alias("n"), skew.alias("skewness"), kurt.alias("excess_kurtosis")]


def totals(x: str = "total") -> list[Column]:
    """13 statistics of totals: mean, sd, median, P90, P95 and strict exceedance rates."""
    c = F.col(x).cast("double")
    over = [F.avg((c > t).cast("double")).alias(f"over_{t}") for t in THRESHOLDS]
    return [F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.9)).alias("p90"), F.percentile(c, F.lit(0.95)).alias("p95"), *over]


def outliers(df: DataFrame, column: str) -> DataFrame:
    """df with fences (1.5 IQR beyond the quartiles) and side: low, high or null; strictly outside."""
    one = df.agg(F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"))
    one = one.select((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper"))
    side = F.when(F.col(column) < F.col("lower"), "low").when(F.col(column) > F.col("upper"), "high")
    return df.crossJoin(F.broadcast(one)).withColumn("side", side)


def bands(df: DataFrame, column: str) -> DataFrame:
    """band: Q0 for zero, quartile bands of positive values, right-closed; equal cuts are merged."""
    pos = F.when(F.col(column) > 0, F.col(column))
    cuts = df.agg(*(F.percentile(pos, F.lit(p)).alias(f"k{i}") for i, p in enumerate((0.25, 0.5, 0.75))), F.min(pos).alias("lo"), F.max(pos).alias("hi"))
    inner = F.array_sort(F.array_distinct(F.filter(F.array("k0", "k1", "k2"), lambda k: (k > F.col("lo")) & (k < F.col("hi")))))
    number = F.size(F.filter("cuts", lambda k: k < F.col(column))) + 1
    return df.crossJoin(F.broadcast(cuts.select(inner.alias("cuts")))).withColumn("band", F.when(F.col(column) == 0, "Q0").when(F.col(column) > 0, F.concat(F.lit("B"), number.cast("string")))).drop("cuts")

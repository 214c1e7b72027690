"""Associations: Pearson, Spearman, within groups, many at once, and adjusted p-values."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import average_ranks


def pearson(x: str, y: str) -> Column:
    """Null for fewer than three pairs or a constant side."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)) & (F.count(a) >= 3)
    # corr() of a constant divides by zero; covariance over guarded deviations doesn't.
    return F.when(varies, F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """n and rho of each group."""
    by = list(by)
    ranked = average_ranks(df.select(*by, x, y).dropna(subset=[x, y]), {x: "_rx", y: "_ry"}, by)
    aggs = [F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("rho")]
    return ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, rho of each pair, all from one pass over ranked rows."""
    ranked = average_ranks(df.select(columns).dropna(), {c: f"_r_{c}" for c in columns})
    pairs = list(combinations(columns, 2))
    one = ranked.agg(*(pearson(f"_r_{a}", f"_r_{b}").alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"p{i}").alias("rho")) for i, (a, b) in enumerate(pairs)))))


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, covariance of each pair, x itself included."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"p{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)))))


def within_groups(df: DataFrame, x: str, y: str, group: str, least: int = 3) -> DataFrame:
    """Correlation of ranks centred in their groups, of groups with `least` rows and variation on both sides."""
    ranked = average_ranks(df.select(group, x, y).dropna(), {x: "_rx", y: "_ry"}, [group])
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    fit = (n >= least) & (F.min(x).over(w) < F.max(x).over(w)) & (F.min(y).over(w) < F.max(y).over(w))
    part = ranked.withColumns({"_n": n, "_fit": fit}).filter("_fit")
    centred = part.withColumns({"_cx": F.col("_rx") / F.col("_n") - (F.col("_n") + 1) / 2 / F.col("_n"), "_cy": F.col("_ry") / F.col("_n") - (F.col("_n") + 1) / 2 / F.col("_n")})
    return centred.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups"), pearson("_cx", "_cy").alias("rho"))


def step_up(df: DataFrame, p: str, ids: list[str]) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values of a short list; nulls stay null."""
    known = df.filter(F.col(p).isNotNull())
    rank = F.row_number().over(Window.orderBy(p, *ids))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    raw = known.withColumn("_r", rank).withColumn("_a", F.col(p) * m / F.col("_r"))
    adj = F.least(F.lit(1.0), F.min("_a").over(Window.orderBy("_r").rowsBetween(0, Window.unboundedFollowing)))
    return raw.withColumn("adjusted", adj).drop("_r", "_a").unionByName(df.filter(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))

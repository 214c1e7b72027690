"""Empirical distribution functions of two samples and their distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import bucketed, gaps, running_counts


def ecdf(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Share of rows up to each distinct value."""
    by = list(by)
    runs = running_counts(df, column, by)
    sizes = df.filter(F.col(column).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else df.agg(F.count(column).alias("_n"))
    joined = runs.join(sizes, by) if by else runs.crossJoin(F.broadcast(sizes))
    return joined.select(*by, column, (F.col("upto") / F.col("_n")).alias("share"))


def two_samples(df: DataFrame, column: str, first: Column) -> DataFrame:
    """The values of both samples, with both distribution functions at them (right-continuous). first: which rows are of the first one."""
    both = df.select(F.col(column), first.alias("_f"))
    counts = both.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count_if("_f").alias("na"), F.count_if(~F.col("_f")).alias("nb"))
    cut = bucketed(counts, column)
    inner = Window.partitionBy("_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy("_bucket").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", *(F.coalesce(F.sum(f"s{x}").over(ahead), F.lit(0)).alias(f"o{x}") for x in "ab"))
    total = counts.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    out = cut.withColumns({f"r{x}": F.sum(f"n{x}").over(inner) for x in "ab"}).join(F.broadcast(offsets), "_bucket").crossJoin(F.broadcast(total))
    return out.select(column, *(((F.col(f"r{x}") + F.col(f"o{x}")) / F.nullif(F.col(f"t{x}"), F.lit(0))).alias(f"f{x}") for x in "ab"))


def distances(df: DataFrame, column: str, first: Column) -> DataFrame:
    """Largest difference of the two distribution functions, and the area between them (Wasserstein-1)."""
    values = gaps(two_samples(df, column, first), column, "_next")
    diff = F.abs(F.col("fa") - F.col("fb"))
    return values.agg(F.max(diff).alias("sup_distance"), F.sum(diff * (F.col("_next") - F.col(column))).alias("wasserstein"))

"""Running totals and ranks over a whole table without a single-partition window.

Values are cut into buckets at approximate quantiles. A window inside each bucket and a window over the buckets' totals, at most
BUCKETS rows a group, add up to the total over all rows. Results don't depend on the cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """df with _bucket, how many of the cut points lie below the column. The cuts are one row, joined in the same job."""
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("_cuts"))
    at = F.size(F.filter("_cuts", lambda c: c < F.col(column).cast("double")))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.coalesce(at, F.lit(0))).drop("_cuts")


def running_counts(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """A row for each value of the column in each group: n, its rows, and upto, the rows with this value or a smaller one."""
    counts = bucketed(df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n")), column)
    inside = F.sum("n").over(Window.partitionBy(*by, "_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    sums = counts.groupBy(*by, "_bucket").agg(F.sum("n").alias("_all"))
    before = F.sum("_all").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    out = counts.withColumn("_in", inside).join(offsets, [*by, "_bucket"])
    return out.select(*by, column, "n", (F.col("_in") + F.col("_before")).alias("upto"))


def running_sum(df: DataFrame, column: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over rows up to each one, in the order of a column without ties."""
    cut = bucketed(df, column)
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    sums = cut.groupBy("_bucket").agg(F.sum(value).alias("_all"))
    before = F.sum("_all").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    # One row a bucket, BUCKETS at most.
    offsets = sums.select("_bucket", before.alias("_before"))
    out = cut.withColumn(name, inside).join(F.broadcast(offsets), "_bucket")
    return out.withColumn(name, F.col(name) + F.coalesce(F.col("_before"), F.lit(0))).drop("_bucket", "_before")


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with gapless numbers from 0, in the order of a column without ties."""
    out = running_sum(df.withColumn("_one", F.lit(1)), column, "_one", name)
    return out.withColumn(name, F.col(name) - 1).drop("_one")


def average_ranks(df: DataFrame, names: dict[str, str], by: list[str] = ()) -> DataFrame:
    """df with the rank of each column's value under the name told, ties sharing the mean of their places. Each column is ranked from df itself, so plans grow with the number of columns only."""
    by, out = list(by), df
    for column, name in names.items():
        ranks = running_counts(df, column, by).select(*by, column, (F.col("upto") - (F.col("n") - 1) / 2).alias(name))
        out = out.join(ranks, [*by, column])
    return out


def gaps(df: DataFrame, column: str, name: str) -> DataFrame:
    """df (a row for each distinct value) with the next larger value, null for the largest; over buckets too."""
    b = bucketed(df, column)
    w = Window.partitionBy("_bucket").orderBy(column)
    heads = b.groupBy("_bucket").agg(F.min(column).alias("_head"))
    nexts = heads.select("_bucket", F.lead("_head").over(Window.orderBy("_bucket")).alias("_after"))
    return b.withColumn(name, F.lead(column).over(w)).join(F.broadcast(nexts), "_bucket").withColumn(name, F.coalesce(name, "_after")).drop("_bucket", "_after")

"""Tables that the plans start from: notice rows, the cohort of orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Government level for each market segment.
LEVELS = {"BUILDING": "local", "MACHINERY": "regional", "HOUSEHOLD": "national", "FURNITURE": "special", "AUTOMOBILE": "local"}
GAP = 900


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("ship", F.to_date("l_shipdate"))


def phases(spark: SparkSession, d: str) -> DataFrame:
    """Orders of four lines or more with their phases. An order has a few lines, so its days fit in a list."""
    days = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("ship")).alias("days"), F.sum("l_quantity").cast("bigint").alias("q"), F.count(F.lit(1)).alias("n")).filter("n >= 4")
    gap = lambda i: F.datediff(F.col("days")[i], F.col("days")[i - 1])
    return days.select(F.col("l_orderkey").alias("procedure_code"), "q", gap(1).alias("t1"), F.greatest(gap(2) - GAP, F.lit(0)).alias("t2"), gap(3).alias("t3"))


def positive(spark: SparkSession, d: str) -> DataFrame:
    """Phases with positive first and last phase, and the order's attributes."""
    p = phases(spark, d).filter("t1 > 0 AND t3 > 0").withColumn("total", F.col("t1") + F.col("t2") + F.col("t3"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("notice_year"))
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    level = F.coalesce(*(F.when(F.col("c_mktsegment") == k, v) for k, v in LEVELS.items()))
    joined = p.join(orders, p.procedure_code == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("procedure_code", F.col("o_custkey").alias("entity"), level.alias("government"), F.col("o_totalprice").alias("amount"), "notice_year", "q", "t1", "t2", "t3", "total")


def with_scenario(df: DataFrame) -> DataFrame:
    """Strict extremes: below P25 of q low, above P75 high, between and at them medium."""
    cuts = df.agg(F.percentile("q", F.lit(0.25)).alias("_p25"), F.percentile("q", F.lit(0.75)).alias("_p75"))
    scenario = F.when(F.col("q") < F.col("_p25"), "low").when(F.col("q") > F.col("_p75"), "high").otherwise("medium")
    return df.crossJoin(F.broadcast(cuts)).withColumn("scenario", scenario).drop("_p25", "_p75")


def cohort(spark: SparkSession, d: str) -> DataFrame:
    return with_scenario(positive(spark, d))


_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items()) + " END"
PHASES_SQL = f"""days AS (SELECT l_orderkey, list_sort(list(CAST(l_shipdate AS DATE))) AS days, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1 HAVING count(*) >= 4),
phases AS (SELECT l_orderkey AS procedure_code, q, CAST(days[2]-days[1] AS INTEGER) AS t1, CAST(greatest(days[3]-days[2]-{GAP}, 0) AS INTEGER) AS t2, CAST(days[4]-days[3] AS INTEGER) AS t3 FROM days)"""
COHORT_SQL = f"""WITH {PHASES_SQL},
base AS (SELECT procedure_code, o_custkey AS entity, {_CASE} AS government, o_totalprice AS amount, CAST(year(o_orderdate) AS INTEGER) AS notice_year, q, t1, t2, t3, t1+t2+t3 AS total
  FROM phases JOIN orders ON o_orderkey = procedure_code JOIN customer ON c_custkey = o_custkey WHERE t1 > 0 AND t3 > 0),
cuts AS (SELECT quantile_cont(q, 0.25) AS p25, quantile_cont(q, 0.75) AS p75 FROM base),
cohort AS (SELECT base.*, CASE WHEN q < p25 THEN 'low' WHEN q > p75 THEN 'high' ELSE 'medium' END AS scenario FROM base, cuts)
"""

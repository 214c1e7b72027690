"""Consensus over the rows of a key, and reconciliation of two key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consensus(c: str) -> Column:
    """The only distinct value that isn't null, else null."""
    return F.when(F.min(c) == F.max(c), F.max(c))


def strict(c: str) -> Column:
    """The same, if no row of the group lacks a value."""
    return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.max(c))


def conflicts(columns: list[str]) -> Column:
    """Names of columns with several values, joined by ' | '."""
    return F.concat_ws(" | ", *(F.when(F.min(c) != F.max(c), F.lit(c)) for c in columns))


def sorted_distinct(c: str, sep: str = " | ") -> Column:
    return F.concat_ws(sep, F.array_sort(F.collect_set(F.col(c).cast("string"))))


def in_order(c: Column, position: Column, sep: str = " || ") -> Column:
    """Distinct values joined in the order of their first position."""
    pairs = F.array_sort(F.collect_list(F.struct(position.alias("p"), c.alias("v"))))
    return F.array_join(F.array_distinct(F.transform(pairs, lambda x: x["v"].cast("string"))), sep)


def indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both sides, with match: both, left_only or right_only."""
    l = left.select(keys).distinct().withColumn("_l", F.lit(True))
    r = right.select(keys).distinct().withColumn("_r", F.lit(True))
    match = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return l.join(r, keys, "full_outer").withColumn("match", match).drop("_l", "_r")


def one_to_one(df: DataFrame, key: str) -> DataFrame:
    """df, whose evaluation fails if a key has several rows."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("_bad"))
    checked = n.select(F.assert_true(F.col("_bad") == 0, "keys aren't unique").isNull().alias("_ok"))
    return df.crossJoin(F.broadcast(checked)).filter("_ok").drop("_ok")


def join_faults(left: DataFrame, right: DataFrame, keys: list[str], most: tuple[int, int] = (1, 1), covered: bool = True) -> DataFrame:
    """Keys that break a join's contract, with fault: left_repeated, right_repeated (more rows of the key on that side than allowed; 0: any number), unmatched (a left key that the right side lacks) or null_key (rows without a key)."""
    sides = [side.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "left_rows"), (right, "right_rows"))]
    known = sides[0].join(sides[1], keys, "full_outer").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("left_rows", "right_rows")})
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    faults = [F.when(empty, F.lit("null_key"))]
    faults += [F.when(~empty & (F.col(f"{side}_rows") > n), F.lit(f"{side}_repeated")) for side, n in zip(("left", "right"), most, strict=True) if n]
    if covered:
        faults.append(F.when(~empty & (F.col("left_rows") > 0) & (F.col("right_rows") == 0), F.lit("unmatched")))
    return known.withColumn("fault", F.explode(F.array_compact(F.array(*faults)))).select(*keys, "left_rows", "right_rows", "fault")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: tuple[int, int] = (1, 1), covered: bool = True, told: int = 5) -> DataFrame:
    """left joined to right; evaluating it fails, naming some of the keys, where the contract of join_faults is broken. The check is part of the plan: one row that every result row has to meet."""
    faults = join_faults(left, right, keys, most, covered)
    named = F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    # The least few names, kept small in every task.
    worst = faults.select("fault", named.alias("key")).orderBy("fault", "key").limit(told)
    one = worst.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "fault", "key"))), "; ").alias("what"))
    fine = one.select(F.assert_true(F.col("n") == 0, F.concat(F.lit("join contract broken: "), F.col("what"))).isNull().alias("_fine"))
    out = left.join(right, keys, how)
    # A join without rows would never ask for the check, so an empty side is no excuse for it.
    return out.join(F.broadcast(fine), F.col("_fine"), "inner").drop("_fine")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, labelled."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(name))
    return only(left, right, "left_only").unionByName(only(right, left, "right_only"))

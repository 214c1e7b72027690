"""Eligibility gates: filters that keep a record of what they remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_gates(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Adds a boolean column for each gate (null fails), the first gate that fails, and whether all pass."""
    out = df.withColumns({g: F.coalesce(c, F.lit(False)) for g, c in gates.items()})
    first = F.coalesce(*(F.when(~F.col(g), F.lit(g)) for g in gates))
    return out.withColumns({"first_failed": first, "eligible": first.isNull()})


def split(df: DataFrame, mask: Column, stage: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with stage and reason."""
    flagged = df.withColumn("_keep", F.coalesce(mask, F.lit(False)))
    kept = flagged.filter("_keep").drop("_keep")
    gone = flagged.filter("NOT _keep").drop("_keep").withColumns({"stage": F.lit(stage), "decision": F.lit("excluded"), "reason": F.lit(reason)})
    return kept, gone


def funnel(df: DataFrame, gates: list[str], entity: str) -> DataFrame:
    """step, gate, rows and distinct entities before and after each gate in turn, from one aggregate."""
    passed, aggs, so_far = [], [], F.lit(True)
    for i, g in enumerate(gates):
        so_far = so_far & F.col(g)
        passed.append(so_far)
        aggs += [F.count_if(so_far).alias(f"r{i + 1}"), F.count_distinct(F.when(so_far, F.col(entity))).alias(f"e{i + 1}")]
    one = df.agg(F.count(F.lit(1)).alias("r0"), F.count_distinct(entity).alias("e0"), *aggs)
    rows = [F.struct(F.lit(i + 1).alias("step"), F.lit(g).alias("gate"), F.col(f"r{i}").alias("rows_before"), F.col(f"r{i + 1}").alias("rows_after"), F.col(f"e{i}").alias("entities_before"), F.col(f"e{i + 1}").alias("entities_after")) for i, g in enumerate(gates)]
    return one.select(F.inline(F.array(*rows)))


def failures(df: DataFrame, gates: list[str]) -> DataFrame:
    """gate, all rows that fail it, rows that fail it first."""
    aggs = [x for g in gates for x in (F.count_if(~F.col(g)).alias(f"a_{g}"), F.count_if(F.col("first_failed") == g).alias(f"f_{g}"))]
    rows = [F.struct(F.lit(g).alias("gate"), F.col(f"a_{g}").alias("n_all"), F.col(f"f_{g}").alias("n_first")) for g in gates]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """check, failures, status: how many rows break each rule (null breaks it), from one aggregate."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())))
    rows = [F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("failures"), F.when(F.col(f"c{i}") == 0, "pass").otherwise("fail").alias("status")) for i, k in enumerate(rules)]
    return one.select(F.inline(F.array(*rows)))

"""A text classifier by rules: evidence of named patterns, and a ladder of decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import upper_norm


@dataclass(frozen=True)
class Rule:
    family: str
    name: str
    pattern: str


#: Rules over normal upper-case text. Patterns mean the same in Java and RE2.
RULES = (
    Rule("positive", "P01_licence", r"\b(?:LICEN[CS]ED?|LICENSE)\b"),
    Rule("positive", "P02_rights", r"\bRIGHTS RESERVED\b"),
    Rule("negative", "N01_shout", r"[A-Z]{2,}!!"),
    Rule("negative", "N02_table", r" \| "),
    Rule("negative", "N03_marks", r"[#$%&*]{3}"),
    Rule("boundary", "B01_address", r"[A-Z0-9.]+@[A-Z0-9]+\.[A-Z]+"),
)


def evidence(df: DataFrame, key: str, column: str, rules=RULES) -> DataFrame:
    """A row for each match: key, family, rule, hit."""
    normal = df.select(key, upper_norm(F.col(column)).alias("_t"))
    found = F.array(*(F.struct(F.lit(r.family).alias("family"), F.lit(r.name).alias("rule"), F.regexp_extract_all("_t", F.lit(r.pattern), F.lit(0)).alias("hits")) for r in rules))
    return normal.select(key, F.explode(found).alias("e")).select(key, "e.family", "e.rule", F.explode("e.hits").alias("hit"))


def classify(df: DataFrame, key: str, column: str, rules=RULES) -> DataFrame:
    """df with decision, rules and hits. Matches never leave their row: no shuffle."""
    t = upper_norm(F.col(column))
    out = df.withColumn("_t", t)
    out = out.withColumn("_e", F.array(*(F.struct(F.lit(r.family).alias("family"), F.lit(r.name).alias("rule"), F.regexp_extract_all("_t", F.lit(r.pattern), F.lit(0)).alias("hits")) for r in rules)))
    out = out.withColumn("_e", F.filter("_e", lambda e: F.size(e["hits"]) > 0))
    has = lambda family: F.exists("_e", lambda e: e["family"] == family)
    pos, neg, bound = has("positive"), has("negative"), has("boundary")
    decision = F.when(bound & ~pos, "excluded").when(bound, "unresolved").when(pos & ~neg, "included").when(neg & ~pos, "excluded").otherwise("unresolved")
    names = F.array_join(F.array_sort(F.transform("_e", lambda e: e["rule"])), " | ")
    hits = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("_e", lambda e: e["hits"])))), " | ")
    return out.withColumns({"decision": decision, "rules": names, "hits": hits}).drop("_t", "_e")

"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed into cells (source, language, topic). Each margin has target
shares for named values, and one share for all other values together, so there are at
most (sources + 1) * (languages + 1) * (topics + 1) cells whatever the input; only these
go to the driver. The cells' weights are raked: scaled to the source shares, to the
language shares, to the topic shares, and again, SWEEPS times. Shares of values that no
row has are dropped and the rest scaled up. A document's probability is its cell's raked
weight over the cell's weight, times the share `budget` of all tokens that the sample is
to hold, and 1 at most: no document is taken twice, so a cell with fewer tokens than its
target asks for is taken whole. A document is sampled if a number in [0, 1) made of its
id is below its probability. So the sample depends on the rows alone.

The tokens of a document are its words, [^ \\t-\\r]+. Null texts and texts without words
have no tokens; they get the probability of their cell, and cells without any tokens the
probability 0. Null sources and languages count as other values. Repeated rows are
decided alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import packed, read

SWEEPS = 24
#: Share of all tokens that a sample is to hold.
BUDGET = 0.7
WORD = r"[^ \t-\r]+"
OTHER = "other"

#: Target shares; OTHER stands for all values that aren't named.
TARGETS = {
    "source": {**{f"src{i}": 0.045 for i in range(20)}, OTHER: 0.10},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.11, OTHER: 0.02},
    "topic": {"plain": 0.90, "tabular": 0.04, "legal": 0.04, "loud": 0.02},
}


def topic(text: Column) -> Column:
    """A coarse topic, told by marks that a text holds."""
    return F.when(F.contains(text, F.lit(" | ")), "tabular").when(F.contains(F.lower(text), F.lit("license")), "legal").when(F.contains(text, F.lit("!! ")), "loud").otherwise("plain")


def unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) made of the key: 48 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), key.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], sweeps: int = SWEEPS) -> dict[tuple, float]:
    """Cells scaled so that their shares by each position of the key meet the targets."""
    w = {k: float(v) for k, v in sorted(cells.items()) if v > 0}
    total = sum(w.values())
    for _ in range(sweeps):
        for at, target in enumerate(targets):
            have: dict[str, float] = {}
            for k, v in w.items():
                have[k[at]] = have.get(k[at], 0.0) + v
            live = sum(target.get(x, 0.0) for x in have)
            w = {k: v * target.get(k[at], 0.0) / live * total / have[k[at]] if live and have[k[at]] else 0.0 for k, v in w.items()}
    return w


def with_cells(docs: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """Adds tokens, topic and the cell's keys _source, _lang and _topic to row, text, source and lang."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c, k: F.when(c.isin(sorted(set(targets[k]) - {OTHER})), c).otherwise(OTHER)
    out = docs.withColumns({"tokens": F.regexp_count(text, F.lit(WORD)).cast("long"), "topic": topic(text)})
    return out.withColumns({"_source": named(F.col("source"), "source"), "_lang": named(F.col("lang"), "lang"), "_topic": named(F.col("topic"), "topic")})


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET, salt: str = "mix") -> DataFrame:
    """Adds tokens, topic, probability and sampled to documents; columns of these names are replaced."""
    keys = ["_source", "_lang", "_topic"]
    rows = with_cells(docs.select(packed(docs, ("tokens", "topic", "probability", "sampled")), "doc_id", "text", "source", "lang"), targets)
    found = {tuple(r[k] for k in keys): r["n"] for r in rows.groupBy(*keys).agg(F.sum("tokens").alias("n")).collect()}
    raked = rake(found, [targets[k] for k in ("source", "lang", "topic")])
    table = docs.sparkSession.createDataFrame([(*k, min(1.0, v / found[k] * budget)) for k, v in raked.items()], "_source string, _lang string, _topic string, _p double")
    # There are no more cells than the targets name.
    out = rows.join(F.broadcast(table), keys, "left").withColumn("probability", F.coalesce("_p", F.lit(0.0)))
    sampled = unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), salt) < F.col("probability")
    return out.select("row.*", "tokens", "topic", "probability", sampled.alias("sampled"))


def document_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs).select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), F.col("sampled").cast("int").alias("sampled"))


def oracle_sql(targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET, salt: str = "mix", sweeps: int = SWEEPS) -> str:
    """The same in DuckDB's SQL."""
    names = {k: ", ".join(f"'{x}'" for x in v if x != OTHER) for k, v in targets.items()}
    shares = {k: ", ".join(f"('{x}', CAST({p!r} AS DOUBLE))" for x, p in v.items()) for k, v in targets.items()}
    word = r"[^ \t\n\x0b\f\r]+"
    steps = [
        f"""docs AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '{word}')) AS tokens,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular' WHEN contains(lower(coalesce(text, '')), 'license') THEN 'legal'
       WHEN contains(coalesce(text, ''), '!! ') THEN 'loud' ELSE 'plain' END AS topic FROM documents)""",
        f"""celled AS (SELECT *, CASE WHEN source IN ({names["source"]}) THEN source ELSE '{OTHER}' END AS k0,
  CASE WHEN lang IN ({names["lang"]}) THEN lang ELSE '{OTHER}' END AS k1, topic AS k2 FROM docs)""",
        "n AS MATERIALIZED (SELECT k0, k1, k2, CAST(sum(tokens) AS DOUBLE) AS n FROM celled GROUP BY ALL HAVING sum(tokens) > 0)",
        "w0 AS MATERIALIZED (SELECT k0, k1, k2, n AS w FROM n)",
        *(f"t{i}(x, share) AS (VALUES {shares[k]})" for i, k in enumerate(("source", "lang", "topic"))),
    ]
    for s in range(3 * sweeps):
        i = s % 3
        steps.append(
            f"w{s + 1} AS MATERIALIZED (SELECT w.k0, w.k1, w.k2, w.w * coalesce(t.share, 0) / l.live * (SELECT sum(n) FROM n) / h.have AS w FROM w{s} w"
            f" JOIN (SELECT k{i} AS k, sum(w) AS have FROM w{s} GROUP BY 1) h ON h.k = w.k{i} LEFT JOIN t{i} t ON t.x = w.k{i}"
            f" CROSS JOIN (SELECT sum(share) AS live FROM t{i} WHERE x IN (SELECT k{i} FROM w{s})) l)"
        )
    last = f"w{3 * sweeps}"
    steps.append(f"p AS MATERIALIZED (SELECT w.k0, w.k1, w.k2, least(1.0, w.w / n.n * {budget!r}) AS p FROM {last} w JOIN n USING (k0, k1, k2))")
    draw = f"CAST(CAST('0x' || substr(md5('{salt}|' || doc_id), 1, 12) AS BIGINT) AS DOUBLE) / {float(1 << 48)!r}"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(coalesce(p.p, 0), 6) AS probability, CAST({draw} < coalesce(p.p, 0) AS INTEGER) AS sampled FROM celled LEFT JOIN p USING (k0, k1, k2)"

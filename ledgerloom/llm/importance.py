"""Resampling of documents towards a target distribution, by hashed features.

Features (runs of words) are hashed into buckets. The log ratio of a bucket's smoothed share
in the target to that in the corpus is its gain, a whole number of thousandths; a
document's weight is the floored mean of its features' gains, looked up in one array of a
number for each bucket. Gumbel noise, which depends on the seed and doc_id alone, is added,
so the highest scores are a draw without replacement by the weights.

The draw is exact and has no sort over all documents: a histogram of the whole-number scores
is summed from the highest score down, which gives each score the rank before its first
document and the cutoff. Only documents at or above the cutoff are numbered, by doc_id within
their score. Scores lie within the gains' range and the noise's (-3,100 to 25,000), so the
histogram has at most some hundred thousand rows whatever the number of documents; with the
counts of buckets it is what the driver holds.

Null texts have no words: weight 0, score by noise alone, not drawn with a `least` over 0. A
null doc_id is hashed as an empty one and comes first among ties. Repeated rows are scored
alike and each may be drawn; rows that agree in score and doc_id are ranked by their number
of features, and are interchangeable if that agrees too. An empty corpus gives an empty
result, an empty target a target of equal shares. Texts of any length are read whole, one at
a time. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bound_batches, lean, pin, read, utf8

#: Of UTF-8 in lower case: digits, a-z and all that is no ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+").findall
#: Features whose buckets a task remembers.
CACHE = 200_000


class Buckets(dict):
    """Buckets of features met so far."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[feature] = n = zlib.crc32(feature) % self.buckets
        return n


def features(text: bytes, shortest: int, longest: int) -> tuple[int, list[bytes]]:
    """How many words the text has, and its runs of shortest to longest words."""
    words = WORD(text.lower())  # of bytes, lower() is that of A-Z
    if shortest == longest == 1:
        return len(words), words
    return len(words), [b" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def bucket_counts(df: DataFrame, column: str, buckets: int, runs: tuple[int, int]) -> np.ndarray:
    """Features in each bucket. A task sends one row for each bucket it has met."""
    bound_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                _, found = features(t.as_buffer().to_pybytes(), *runs)
                total += np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    rows = df.select(utf8(column).alias("text")).mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), for each bucket."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def scored(df: DataFrame, gain: np.ndarray, seed: int, runs: tuple[int, int], key: str, column: str) -> DataFrame:
    """key, n_words, n_features, weight and score of each document."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("doc"), utf8(column).alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for b in batches:
            out = []
            for t in b.column(1):
                words, found = features(t.as_buffer().to_pybytes(), *runs)
                total = int(gain[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum())
                out.append((words, len(found), total // len(found) if found else 0))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc", "n_words", "n_features", "weight"])

    weighed = rows.mapInArrow(lean(weigh), "doc long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(
    df: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024, buckets: int = 10_000, runs: tuple[int, int] = (1, 1), key: str = "doc_id", column: str = "text", target_column: str = "text"
) -> DataFrame:
    """key, n_features, weight, score and rank (null: not drawn) of every document. `percent` percent of those with at least `least` words are drawn."""
    spark = df.sparkSession
    gain = gains(bucket_counts(df, column, buckets, runs), bucket_counts(target, target_column, buckets, runs))
    docs = pin(scored(df, gain, seed, runs, key, column), "importance-scores")
    fit = F.col("n_words") >= least
    counts = sorted(((r["score"], r["n"]) for r in docs.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw, before, offsets = percent * sum(n for _, n in counts) // 100, 0, []
    for score, n in counts:
        if before >= draw:
            break
        offsets.append((score, before))
        before += n
    names = (F.col("doc").alias(key), "n_features", "weight", "score")
    if not offsets:
        return docs.select(*names, F.lit(None).cast("long").alias("rank"))
    above = fit & (F.col("score") >= offsets[-1][0])
    # A row for each surviving score, as many as the scores' range has at most.
    steps = F.broadcast(spark.createDataFrame(offsets, "score long, before long"))
    order = Window.partitionBy("score").orderBy("doc", "n_features", "n_words")
    place = F.row_number().over(order).cast("long") + F.col("before")
    drawn = docs.filter(above).join(steps, "score").withColumn("rank", place)
    drawn = drawn.select(*names, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(docs.filter(~above).select(*names, F.lit(None).cast("long").alias("rank")))


def document_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))


def oracle_sql() -> str:
    """The CRC of distinct words is worked out bit by bit, by its polynomial."""
    word = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return rf"""
WITH RECURSIVE dw AS (SELECT doc_id, {word} AS w FROM documents), bw AS (SELECT {word} AS w FROM benchmark),
s AS (SELECT doc_id, unnest(w) AS w FROM dw), t AS (SELECT unnest(w) AS w FROM bw),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM s UNION SELECT w FROM t)),
tab(n, x, i) AS (SELECT CAST(r AS BIGINT), CAST(r AS BIGINT), 0 FROM (SELECT unnest(range(256)) AS r) UNION ALL SELECT n, {step}, i + 1 FROM tab WHERE i < 8),
crcs AS (SELECT list(x ORDER BY n) AS c FROM tab WHERE i = 8),
b AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(len(h) // 2 AS BIGINT)), lambda i: CAST((strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS BIGINT), 1)) - 1 AS BIGINT))), lambda x, y: xor(x >> 8, c[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, crcs),
sb AS (SELECT bucket, count(*) AS n FROM s JOIN b USING (w) GROUP BY 1), tb AS (SELECT bucket, count(*) AS n FROM t JOIN b USING (w) GROUP BY 1),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM sb) AS s, (SELECT coalesce(sum(n), 0) FROM tb) AS t),
g AS (SELECT sb.bucket, CAST(floor(1000 * ln((coalesce(tb.n, 0) + 1.0::DOUBLE) * (tot.s + 10000)::DOUBLE / ((sb.n + 1.0::DOUBLE) * (tot.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sb LEFT JOIN tb USING (bucket), tot),
m AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM s JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT dw.doc_id, coalesce(m.n, 0) AS n_features, CAST(coalesce(floor(m.total::DOUBLE / m.n), 0) AS BIGINT) AS weight,
 list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(sha256('2024:' || dw.doc_id), 1, 8), ''), lambda q: CAST(strpos('0123456789abcdef', q) - 1 AS BIGINT))), lambda x, y: x * 16 + y) AS h FROM dw LEFT JOIN m USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM z WHERE n_features >= 20) AS fit FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM o"""

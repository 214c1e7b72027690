"""Exact top-k search by inner product, with pivot-table elimination.

Components become integers, floor(256 * x). For each vector a table holds its distances
to PIVOTS pivot vectors. By the triangle inequality the distance of query and candidate
is at least the largest difference of their table rows, and as
2 q.x = |q|^2 + |x|^2 - d^2, that gives the most that their product can be. A query's
candidates are evaluated in order of that bound, in chunks, until the k-th best product
found is above the bound of all that are left. Pivots are rows of the block that lie far from
each other. Where bounds discard little (random vectors of many components), a block's
first queries show it, and its other queries are answered by all products.

Vectors are dealt into blocks of about BLOCK vectors by a hash of vec_id, and queries into
blocks of about QUERIES; each block of queries meets each block of vectors once and
leaves k rows a query, which are merged. No task holds more than one block of each.

Vectors that are null, empty or hold null or non-finite components take no part; the
others must have one length (a query meets only vectors of its own length). Products are
exact: in doubles while they are below 2^53, else in Python's integers; beyond 64 bits
they are held at the largest 64-bit number. Rows that share the query's vec_id are the
query's own row. Other repeated rows are each candidates; equal scores go to the smaller
vec_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bound_batches, lean, pin, read

PIVOTS, BLOCK, QUERIES, CHUNK, PROBE = 24, 8192, 512, 512, 8
EXACT = 2.0**53


def pivots(x: np.ndarray) -> np.ndarray:
    """PIVOTS rows of x, each the farthest from those before it."""
    far, chosen = ((x - x.mean(0)) ** 2).sum(1), []
    for _ in range(min(PIVOTS, len(x))):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def table(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of each row to the pivots."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * x @ p.T, 0))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of whole numbers."""
    if len(x) == 0 or np.abs(q).max() * np.abs(x).max() * len(q) < EXACT:
        return (x @ q).astype(np.int64)
    big = 2**63 - 1
    mine = [int(a) for a in q]
    return np.array([max(-big - 1, min(big, sum(int(a) * b for a, b in zip(row, mine, strict=True)))) for row in x], np.int64)


def best(q: np.ndarray, qd: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, d: np.ndarray, norms: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (product, id) of a block for one query, and how many candidates were evaluated."""
    low = np.abs(d - qd[None, :]).max(1)
    bound = (norms + float(q @ q) - low**2) / 2
    bound += 1e-6 * (np.abs(bound) + norms + float(q @ q)) + 1  # rounding of the table
    order = np.argsort(-bound, kind="stable")
    found_s, found_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        if len(found_s) >= k and bound[order[at]] < found_s[k - 1]:
            break
        take = order[at : at + CHUNK]
        at += len(take)
        take = take[ids[take] != own]
        s, i = np.concatenate([found_s, _exact(q, x[take])]), np.concatenate([found_i, ids[take]])
        top = np.lexsort((i, -s))[:k] if len(s) < 2**62 else None
        found_s, found_i = s[top], i[top]
    return list(zip(found_s.tolist(), found_i.tolist(), strict=True)), at


def plain(q: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The same for many queries, by all products."""
    out = []
    for i in range(0, len(q), 64):
        part = q[i : i + 64]
        safe = np.abs(part).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < EXACT
        scores = (part @ x.T).astype(np.int64) if safe else np.stack([_exact(r, x) for r in part])
        for o, s in zip(own[i : i + 64], scores, strict=True):
            others = ids != o
            s, mine = s[others], ids[others]
            if len(s) > k:  # all that tie with the k-th stay
                few = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, mine = s[few], mine[few]
            top = np.lexsort((mine, -s))[:k]
            out.append(list(zip(s[top].tolist(), mine[top].tolist(), strict=True)))
    return out


def best_of_block(own: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """The k best of a block for each query, and how many candidates were evaluated. If over half of the candidates of PROBE queries had to be, bounds cost more than they save, and the block's other queries go by all products."""
    p = pivots(x)
    d, qd, norms = table(x, p), table(q, p), (x**2).sum(1)
    out, seen = [], 0
    for n, o in enumerate(own):
        if n == PROBE and 2 * seen > PROBE * len(ids):
            return out + plain(q[n:], own[n:], ids, x, k), seen + (len(own) - n) * len(ids)
        found, many = best(q[n], qd[n], o, ids, x, d, norms, k)
        out.append(found)
        seen += many
    return out, seen


def _packed(rows: DataFrame, block: str, name: str) -> DataFrame:
    """One row for each block and length: its ids and vectors as bytes."""

    def run(t: pa.Table) -> pa.Table:
        ids = t["vec_id"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = t["v"].combine_chunks()
        values = flat.flatten().to_numpy(zero_copy_only=False)
        x = np.floor(256 * values.reshape(len(ids), -1))
        order = np.lexsort((*x.T[::-1], ids))
        return pa.table({"block": pa.array([t[block][0].as_py()], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), f"{name}_ids": [ids[order].tobytes()], f"{name}_x": [x[order].tobytes()]})

    return rows.groupBy(block, "dim").applyInArrow(run, f"block int, dim int, {name}_ids binary, {name}_x binary")


def search(df: DataFrame, k: int, every: int) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by `every`, the k best of all others."""
    spark = df.sparkSession
    bound_batches(spark)
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.col("vec_id").isNotNull() & fine).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    blocks, sets = max(1, -(-counts["n"] // BLOCK)), max(1, -(-counts["q"] // QUERIES))
    hashed = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    data = _packed(rows.withColumn("b", hashed(1, blocks)), "b", "c")
    asked = pin(_packed(rows.filter(F.col("vec_id") % every == 0).withColumn("b", hashed(2, sets)), "b", "q"), "topk-queries")
    # A set of queries is one row; it goes to every block of vectors.
    asked = asked.select(F.col("dim").alias("qdim"), "q_ids", "q_x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at"))
    met = pin(data, "topk-blocks").join(asked.hint("shuffle_hash"), (F.col("block") == F.col("at")) & (F.col("dim") == F.col("qdim"))).select("dim", "c_ids", "c_x", "q_ids", "q_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column(0)[r].as_py()
                raw = [b.column(c)[r].as_buffer() for c in range(1, 5)]
                ids, own = (np.frombuffer(raw[i], np.int64) for i in (0, 2))
                x, q = (np.frombuffer(raw[i], np.float64).reshape(-1, dim) for i in (1, 3))
                out = [(int(o), s, i) for o, found in zip(own, best_of_block(own, q, ids, x, k)[0], strict=True) for s, i in found]
                cols = zip(*out, strict=True) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["query_id", "score", "vec_id"])

    part = met.mapInArrow(lean(run), "query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 5, 50)

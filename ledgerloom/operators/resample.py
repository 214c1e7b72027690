"""Bootstrap of whole clusters: clusters are drawn with replacement, rows count as often as their cluster was drawn.

Copies are never made. Clusters are numbered and lie in blocks; a replicate's draws are places in blocks, two bytes each, dealt
to tasks by block and run of replicates. There draws become weights of the block's clusters, and what goes on is a
replicate's sums, or a run's weights by value, a row of numbers for each replicate. The random numbers are those of rng.uniform,
in arrays. Rows and, where they are read twice, draws are stored once. Ranks and quantiles hold a side's different values of a
run of replicates in a task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .describe import THRESHOLDS
from .groups import stored
from .order import numbered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

#: Fewest clusters that may be resampled, and the share of replicates that an interval needs.
MIN_CLUSTERS, USABLE = 20, 0.9
#: Clusters in a block, replicates in a group of a task, and slots that are hashed at once.
BLOCK, RUN, SLOTS = 1 << 16, 50, 1 << 15


_TURNS = [[(np.array(t, np.uint32), np.array(32 - t, np.uint32)) for t in turns] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]


def _tails(at: int, start: int, end: int) -> dict[int, np.ndarray]:
    """What slots put into MD5's block of 64 bytes after a key's first `at` bytes, by the place of the word: decimal digits, the mark after them and the length. All replicates share it."""
    slots = np.arange(start, end)
    width = np.ones(len(slots), np.int64)
    for k in range(1, len(str(end))):
        width += slots >= 10**k
    if at + width.max() > 55:
        raise ValueError("a key has 55 bytes at most")
    block = np.zeros((len(slots), 64), np.uint8)
    for k in range(int(width.max())):
        some = np.flatnonzero(width > k)
        block[some, at + width[some] - 1 - k] = slots[some] // 10**k % 10 + 48
    block[np.arange(len(slots)), at + width] = 0x80
    block[:, 56:58] = (8 * (at + width)).astype("<u2").view(np.uint8).reshape(-1, 2)
    words = block.view("<u4")
    return {i: np.ascontiguousarray(words[:, i]) for i in range(16) if words[:, i].any()}


def _md5(prefix: bytes, start: int, end: int, tails: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of a prefix and each slot's decimal digits, in one block of 64 bytes."""
    words: list = [int.from_bytes(prefix[i : i + 4], "little") for i in range(0, 64, 4)]
    for i, w in tails(len(prefix), start, end).items():
        words[i] = w + np.uint32(words[i])
    first = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(end - start, v) for v in first)
    f = np.empty_like(a)
    # Arrays are changed in place: the time is that of passes over memory.
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, f)
            f |= b
            f ^= c
            g = 7 * i % 16
        step = int(abs(math.sin(i + 1)) * (1 << 32))
        if isinstance(words[g], int):
            f += np.array((step + words[g]) & 0xFFFFFFFF, np.uint32)
        else:
            f += words[g]
            f += np.array(step, np.uint32)
        a += f
        turn, rest = _TURNS[i // 16][i % 4]
        np.right_shift(a, rest, f)
        a <<= turn
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return first[0] + a, first[1] + b


def _hits(seed: str, rep: int, start: int, stop: int, g: int, tails: Callable = _tails) -> np.ndarray:
    """The ordinals that a replicate draws in slots from start to before stop: floor(g * rng.uniform(seed, rep, slot))."""
    out, prefix = [], f"{seed}|{rep}|".encode()
    for at in range(start, stop, SLOTS):
        x, y = _md5(prefix, at, min(stop, at + SLOTS), tails)
        top = (x.byteswap().astype(np.uint64) << np.uint64(16)) | (y.byteswap() >> np.uint32(16))
        out.append(((top.astype(float) + 0.5) / float(1 << 48) * g).astype(np.int64))
    return np.concatenate(out)


def drawn(spark: SparkSession, g: int, reps: int, seed: str) -> DataFrame:
    """The draws of all replicates, as many each as there are clusters (g): block and places in it (two bytes each) of drawn ordinals. No rows for fewer than MIN_CLUSTERS."""
    each = max(1, min(g, 4 * SLOTS))
    n = reps * -(-g // each) if g >= MIN_CLUSTERS else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = lru_cache(maxsize=32)(_tails)  # here, as it goes to workers by reference
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            rep, start = i % reps, i // reps * each
            hits = _hits(seed, rep, start, min(g, start + each), g, tails)
            hits = np.sort(hits.astype(np.int32) if g < 1 << 31 else hits)
            blocks = range(int(hits[0]) // BLOCK, int(hits[-1]) // BLOCK + 1)
            at = np.searchsorted(hits, [k * BLOCK for k in (*blocks, blocks[-1] + 1)]).tolist()
            parts = [(hits[i:j] % BLOCK).astype("<u2").tobytes() for i, j in zip(at, at[1:], strict=False)]
            ints = lambda v: pa.array([v] * len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), ints(rep // RUN), ints(rep), pa.array(parts, pa.binary())], ["block", "run", "rep", "hits"])

    tasks = min(max(n, 1), max(4 * spark.sparkContext.defaultParallelism, n * each >> 24))
    return spark.range(0, n, 1, tasks).mapInArrow(run, "block long, run long, rep long, hits binary")


def numbered_rows(df: DataFrame, cluster: str, columns: list[str]) -> tuple[DataFrame, int]:
    """Rows in blocks of clusters: block, and Arrow streams of _at (the place in the block of the cluster), the columns and _n, equal rows being one; and the number of clusters."""
    counts = stored(df.groupBy(cluster, *columns).agg(F.count(F.lit(1)).alias("_n")), "resample-rows")
    clusters = stored(numbered(counts.select(cluster).distinct(), cluster, "_ordinal"), "resample-clusters")
    g = clusters.count()
    rows = counts.join(clusters, cluster).select(F.floor(F.col("_ordinal") / BLOCK).cast("long").alias("block"), (F.col("_ordinal") % BLOCK).cast("int").alias("_at"), *columns, "_n")

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.drop_columns(["block"]).schema) as out:
            out.write_table(t.drop_columns(["block"]))
        return pa.table({"block": t["block"][:1], "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return stored(rows.groupBy("block").applyInArrow(pack, "block long, rows binary"), "resample-blocks"), g


_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def replicates(rows: DataFrame, hits: DataFrame, reps: int, make: Callable, schema: str, told: DataFrame | None = None) -> DataFrame:
    """What make(rows of a block as a pandas frame, draws, run, told) yields: columns of the schema, for each block and run of RUN replicates.

    draws() goes through the run's replicates that draw from the block: rep, and how often it drew each of the block's clusters. Rows go to reps / RUN groups and
    each draw to one. told: run and a binary column told, what make is told of the run.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((reps - 1) // RUN).cast("long")))
    left = hits.withColumn("told", F.lit(None).cast("binary"))
    if told is not None:
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        left = left.unionByName(told.select("run", none("rep", "long"), none("hits", "binary"), "told").join(rows.select("block"), how="cross"))
    left, right = left.repartition(n, "block", "run"), rows.withColumn("run", runs).repartition(n, "block", "run")
    kinds = [c.split() for c in schema.split(", ")]

    def run(draws: pa.Table, held: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        known = None
        for rep, h, t in zip(draws["rep"].to_pylist(), draws["hits"].to_pylist(), draws["told"].to_pylist(), strict=True):
            if t is not None:
                known = t
            else:
                parts.setdefault(rep, []).append(h)

        def weights() -> Iterator[tuple[int, np.ndarray]]:
            for rep in sorted(parts):
                yield rep, np.bincount(np.frombuffer(b"".join(parts[rep]), "<u2"), minlength=BLOCK).astype(float)

        out: list[dict] = []
        for data, k in zip(held["rows"].to_pylist() if parts else [], held["run"].to_pylist(), strict=False):
            out += make(pa.ipc.open_stream(data).read_all().to_pandas(), weights, k, known)
        if not out:
            return pa.table({c: pa.array([], _KINDS[k]) for c, k in kinds})
        whole = lambda c: pa.array([x for o in out for x in o[c]] if isinstance(out[0][c], list) else np.concatenate([o[c] for o in out]))
        return pa.table({c: whole(c).cast(_KINDS[k]) for c, k in kinds})

    return left.groupBy("block", "run").cogroup(right.groupBy("block", "run")).applyInArrow(run, schema)


def weighted(df: DataFrame, cluster: str, reps: int, seed: str, columns: list[str]) -> DataFrame:
    """rep, the columns and w, how many rows of the replicate have these values."""
    rows, g = numbered_rows(df, cluster, columns)
    kinds = dict(df.select(*columns).dtypes)
    plain = {c: "string" if k == "string" else "double" if k in ("double", "float") else "long" for c, k in kinds.items()}

    def make(held, draws, *_):
        code = held.groupby(columns, dropna=False, sort=False).ngroup().to_numpy()
        first = np.unique(code, return_index=True)[1]
        values = {c: held[c].to_numpy()[first] for c in columns}
        at, n = held["_at"].to_numpy(), held["_n"].to_numpy().astype(float)
        for rep, times in draws():
            w = np.bincount(code, times[at] * n, len(first))
            some = np.flatnonzero(w)
            yield {"rep": np.full(len(some), rep, np.int64), **{c: list(v[some]) if plain[c] == "string" else v[some] for c, v in values.items()}, "w": w[some].astype(np.int64)}

    schema = "rep long, " + ", ".join(f"{c} {k}" for c, k in plain.items()) + ", w long"
    found = replicates(rows, drawn(df.sparkSession, g, reps, seed), reps, make, schema)
    return found.groupBy("rep", *columns).agg(F.sum("w").alias("w"))


def moments(df: DataFrame, cluster: str, reps: int, seed: str, terms: dict[str, Column]) -> DataFrame:
    """rep and the sum of each term over the replicate's rows. Sums are linear in draws, so rows count as their cluster's sums."""
    sums = df.groupBy(cluster).agg(*(F.coalesce(F.sum(t.cast("double")), F.lit(0.0)).alias(k) for k, t in terms.items()))
    names = [*terms]
    rows, g = numbered_rows(sums, cluster, names)

    def make(held, draws, *_):
        at, m = held["_at"].to_numpy(), held[names].to_numpy(float)
        for rep, times in draws():
            yield {"rep": np.array([rep]), **dict(zip(names, (times[at] @ m).reshape(-1, 1), strict=True))}

    schema = "rep long, " + ", ".join(f"{k} double" for k in names)
    found = replicates(rows, drawn(df.sparkSession, g, reps, seed), reps, make, schema)
    return found.groupBy("rep").agg(*(F.sum(k).alias(k) for k in names))


def _rows(values: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes]:
    """A run's weights by value, a row for each of its replicates, as bytes: values, and weights in four bytes if they fit."""
    return values.tobytes(), weights.astype("<u4" if weights.max(initial=0) < 1 << 32 else "<i8").tobytes()


def _united(values: list[bytes], weights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """_rows of several blocks as one: the values in order and the sums of their weights."""
    own = [np.frombuffer(v) for v in values]
    x = np.unique(np.concatenate(own))
    w = np.zeros((RUN, len(x)), np.int64)
    for v, data in zip(own, weights, strict=True):
        w[:, np.searchsorted(x, v)] += np.frombuffer(data, "<u4" if len(data) == 4 * RUN * len(v) else "<i8").reshape(RUN, -1)
    return x, w


def summaries(df: DataFrame, cluster: str, reps: int, seed: str, by: str, x: str) -> DataFrame:
    """rep, by and describe.totals() of x over each replicate's rows of a group; neither column has nulls, groups are few."""
    rows, g = numbered_rows(df.select(cluster, by, F.col(x).cast("double").alias(x)), cluster, [by, x])
    quantiles = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    names = ["mean", "sd", *quantiles, *(f"over_{t}" for t in THRESHOLDS)]

    def make(held, draws, run, _):
        at, n = held["_at"].to_numpy(), held["_n"].to_numpy().astype(float)
        sides = []
        for group, rows_ in held.groupby(by).indices.items():
            values, code = np.unique(held[x].to_numpy()[rows_], return_inverse=True)
            sides.append((group, at[rows_], n[rows_], values, code, np.zeros((RUN, len(values)), np.int64)))
        for rep, times in draws():
            for _, own, many, values, code, w in sides:
                w[rep - run * RUN] = np.bincount(code, times[own] * many, len(values))
        for group, _, _, values, _, w in sides:
            v, data = _rows(values, w)
            yield {"run": np.array([run]), "by": [group], "xs": [v], "ws": [data]}

    def told(t: pa.Table) -> pa.Table:
        values, weights = _united(t["xs"].to_pylist(), t["ws"].to_pylist())
        mid = values.mean()
        off, found = values - mid, []
        for k, w in enumerate(weights):
            n = int(w.sum())
            if n:
                s, ss, upto = float(w @ off), float(w @ (off * off)), np.cumsum(w)
                row = {"rep": t["run"][0].as_py() * RUN + k, "mean": mid + s / n, "sd": math.sqrt(max(ss - s * s / n, 0.0) / (n - 1)) if n > 1 else None}
                for name, p in quantiles.items():
                    place = p * (n - 1)
                    low, high = values[np.searchsorted(upto, [math.floor(place), math.ceil(place)], "right")].tolist()
                    row[name] = low + (high - low) * (place - math.floor(place))
                found.append(row | {f"over_{c}": int(w[values > c].sum()) / n for c in THRESHOLDS})
        some = {c: pa.array([r[c] for r in found], pa.int64() if c == "rep" else pa.float64()) for c in ("rep", *names)}
        return pa.table({"rep": some.pop("rep"), by: pa.array([t["by"][0].as_py()] * len(found), pa.string()), **some})

    found = replicates(rows, drawn(df.sparkSession, g, reps, seed), reps, make, "run long, by string, xs binary, ws binary")
    return found.groupBy("run", "by").applyInArrow(told, f"rep long, {by} string, " + ", ".join(f"{c} double" for c in names))


def correlations(df: DataFrame, cluster: str, reps: int, seed: str, x: str, y: str) -> DataFrame:
    """rep, pearson and spearman (ties share the mean of their places) of each replicate's rows, which have no nulls; null for fewer than three rows or a constant side.

    The first pass counts each side's values, which tells a replicate's ranks; the second sums the products of ranks. Both read the same stored draws.
    """
    spark, sides = df.sparkSession, (x, y)
    rows, g = numbered_rows(df.select(cluster, *(F.col(c).cast("double").alias(c) for c in sides)), cluster, [x, y])
    hits = stored(drawn(spark, g, reps, seed), "resample-draws")

    def coded(held):
        """Rows in the order of the first side: places, how many they are, and both sides' values and codes."""
        held = held.sort_values(x, kind="stable")
        return held["_at"].to_numpy(), held["_n"].to_numpy().astype(float), *(np.unique(held[c].to_numpy(), return_inverse=True) for c in sides)

    def count(held, draws, run, _):
        at, n, (xv, xc), (yv, yc) = coded(held)
        xw, yw, xy = np.zeros((RUN, len(xv)), np.int64), np.zeros((RUN, len(yv)), np.int64), np.zeros(RUN)
        starts = np.searchsorted(xc, np.arange(len(xv)))
        products = np.bincount(at, n * xv[xc] * yv[yc], BLOCK)
        for rep, times in draws():
            k, w = rep - run * RUN, times[at] * n
            xw[k], yw[k], xy[k] = np.add.reduceat(w, starts), np.bincount(yc, w, len(yv)), times @ products
        (xs, xws), (ys, yws) = _rows(xv, xw), _rows(yv, yw)
        yield {"run": np.array([run]), "xs": [xs], "xws": [xws], "ys": [ys], "yws": [yws], "xy": [xy.tobytes()]}

    def ranks(t: pa.Table) -> pa.Table:
        run, held, out = t["run"][0].as_py(), [_united(t[c].to_pylist(), t[f"{c[0]}ws"].to_pylist()) for c in ("xs", "ys")], []
        xy = sum(np.frombuffer(b) for b in t["xy"].to_pylist())
        total = held[0][1].sum(1)
        own = [np.cumsum(w, 1) - (w - 1) / 2 - (total[:, None] + 1) / 2 for _, w in held]  # from the mean rank
        co = lambda n, pq, p, q: pq / n - p / n * (q / n)
        for k in range(min(RUN, reps - run * RUN)):
            n, sums, squares, spread = float(total[k]), [], [], []
            for (v, w), r in zip(held, own, strict=True):
                sums.append(float(w[k] @ v))
                squares.append(float(w[k] @ (v * v)))
                spread.append(float(w[k] @ (r[k] * r[k])))
            varies = n >= 3 and all(np.count_nonzero(w[k]) > 1 for _, w in held)
            both = math.sqrt(co(n, squares[0], sums[0], sums[0]) * co(n, squares[1], sums[1], sums[1])) if varies else 0.0
            out.append((run * RUN + k, co(n, xy[k], *sums) / both if both else None, math.sqrt(spread[0] * spread[1]) if varies else None))
        # What the run's second pass is told lies in its first row.
        told = np.array([len(v) for v, _ in held], "<i8").tobytes() + b"".join(v.tobytes() for v, _ in held) + b"".join(r.tobytes() for r in own)
        rep, pearson, spread = zip(*out, strict=True)
        told_ = pa.array([told] + [None] * (len(rep) - 1), pa.binary())
        return pa.table({"rep": pa.array(rep, pa.int64()), "pearson": pa.array(pearson, pa.float64()), "spread": pa.array(spread, pa.float64()), "run": pa.array([run] * len(rep), pa.int64()), "told": told_})

    found = replicates(rows, hits, reps, count, "run long, xs binary, xws binary, ys binary, yws binary, xy binary")
    each = stored(found.groupBy("run").applyInArrow(ranks, "rep long, pearson double, spread double, run long, told binary"), "resample-ranks")

    def cross(held, draws, run, told):
        at, n, (xv, xc), (yv, yc) = coded(held)
        a, b = np.frombuffer(told, "<i8", 2).tolist()
        flat = np.frombuffer(told, float, offset=16)
        xs, ys, xr, yr = np.split(flat, np.cumsum([a, b, RUN * a]))
        xr, yr = xr.reshape(RUN, a)[:, np.searchsorted(xs, xv)], yr.reshape(RUN, b)[:, np.searchsorted(ys, yv)]
        starts = np.searchsorted(xc, np.arange(len(xv)))
        for rep, times in draws():
            k, w = rep - run * RUN, times[at] * n
            w *= yr[k][yc]
            yield {"rep": np.array([rep]), "xy": np.array([np.add.reduceat(w, starts) @ xr[k]])}

    sums = replicates(rows, hits, reps, cross, "rep long, xy double", each.filter("told IS NOT NULL").select("run", "told")).groupBy("rep").agg(F.sum("xy").alias("xy"))
    return each.join(sums, "rep").select("rep", "pearson", (F.col("xy") / F.nullif(F.col("spread"), F.lit(0.0))).alias("spearman"))


def sd(n: Column, s: Column, ss: Column) -> Column:
    """Sample standard deviation, of the number of values, their sum and their squares' sum; null for one or none."""
    return F.when(n > 1, F.sqrt(F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1)))


def intervals(reps: DataFrame, names: list[str], replicates: int, by: list[str] = ()) -> DataFrame:
    """Percentile intervals of each statistic over replicates in which it is defined; null if fewer than a share of USABLE."""
    needed = math.ceil(USABLE * replicates)
    wide = reps.unpivot(list(by), names, "statistic", "value") if by else reps.select(F.lit(1).alias("_"), *names).unpivot(["_"], names, "statistic", "value")
    n, v = F.count("value"), F.col("value")
    return wide.groupBy(*by, "statistic").agg(n.alias("usable"), *(F.when(n >= needed, F.percentile(v, F.lit(p))).alias(k) for k, p in (("low", 0.025), ("high", 0.975))))

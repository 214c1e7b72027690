"""Nested selection among conditional lognormal models: every fold and model in the same passes.

Rows lie in cells (outer fold, inner fold). Each training set is a union of cells, so one
grouped aggregate of raw moments gives all transforms, all least-squares starts and all models
with a constant scale. The others take scoring steps together: a pass over the rows serves all
fits, tasks reduce their rows to a row a trial, and what comes to the driver is bounded by the
number of trials. One more pass scores all held-out rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model

RAW = ("one", "lq", "la", "regional", "national", "regular")
BASIS = ("one", "zq", "regional_c", "national_c", "zamount")
MODELS = ("M0", "M1", "M2", "M3", "M4")
ABLATIONS = ("M2_noQ", "M3_noQ", "M4_noQ")
# The contrasts of out-of-fold scores, and the guard (share of M1's error, loss of coverage, points of bias).
CONTRASTS = (("M1", "M0"), ("M2", "M1"), ("M3", "M1"), ("M4", "M1"), ("M2", "M2_noQ"), ("M3", "M3_noQ"), ("M4", "M4_noQ"))
GUARD_MAE, GUARD_COVERAGE, GUARD_BIAS = 1.10, 0.05, 10.0
#: The context whose training rows are all rows.
ALL = "all"


def terms(name: str) -> list[int]:
    cols = model.DESIGNS[name.removesuffix("_noQ")]
    return [BASIS.index(c) for c in cols if c != "zq" or not name.endswith("_noQ")]


def scaled(name: str) -> bool:
    """Whether log sigma is linear in zq."""
    return name in MODELS[1:]


@dataclass
class TrainingSet:
    """Rows of a union of cells; what is fitted on them is applied to the cells of `held`."""

    stage: str
    context: str
    models: tuple[str, ...]
    cells: list[int]
    held: list[int]
    transform: np.ndarray = field(default=None)
    sums: np.ndarray = field(default=None)


@dataclass(frozen=True)
class Selection:
    """audit: a row for each context and eligible model; contrasts and metrics: of outer held-out rows."""

    audit: list[dict]
    contrasts: list[dict]
    metrics: list[dict]
    passes: int


def training_sets(folds: int) -> list[TrainingSet]:
    cell = lambda o, i: o * folds + i
    sets = []
    for c in [*range(folds), None]:
        name, rest = ALL if c is None else f"outer_{c}", [o for o in range(folds) if o != c]
        for f in range(folds):
            sets.append(TrainingSet("inner", name, MODELS, [cell(o, i) for o in rest for i in range(folds) if i != f], [cell(o, f) for o in rest]))
        if c is not None:
            sets.append(TrainingSet("outer", name, MODELS + ABLATIONS, [cell(o, i) for o in rest for i in range(folds)], [cell(c, i) for i in range(folds)]))
    return sets


def raw_rows(df: DataFrame, outer: str, inner: str, cluster: str, y: str, folds: int) -> DataFrame:
    """Raw columns, the outcome and the cell of each row."""
    regular = F.col("government").isin(*model.REGULAR)
    level = lambda name: (regular & (F.col("government") == name)).cast("double")
    return df.select(
        (F.col(outer) * folds + F.col(inner)).cast("int").alias("cell"), F.col(cluster).alias("cluster"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("one"), F.log1p(F.col("q").cast("double")).alias("lq"),
        F.log(F.col("amount").cast("double")).alias("la"), level("regional").alias("regional"), level("national").alias("national"), F.coalesce(regular.cast("double"), F.lit(0.0)).alias("regular"),
    )


def _moments(rows: DataFrame, folds: int) -> np.ndarray:
    """Sums of products of raw columns and the log outcome, for each cell. Refuses what no model can be fitted on."""
    cols = [*map(F.col, RAW), F.log("y")]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    odd = F.count_if(~F.coalesce((F.col("y") > 0) & F.col("lq").isNotNull() & F.col("la").isNotNull(), F.lit(False)))
    out = np.zeros((folds * folds, len(cols), len(cols)))
    for row in rows.groupBy("cell").agg(odd, *(F.sum(cols[i] * cols[j]) for i, j in pairs)).collect():
        if row[0] is None or not 0 <= row[0] < len(out):
            raise ValueError("rows without a fold")
        if row[1]:
            raise ValueError("outcomes and amounts must be positive, quantities known")
        for (i, j), v in zip(pairs, row[2:], strict=True):
            out[row[0], i, j] = out[row[0], j, i] = v
    crossing = rows.groupBy("cluster").agg((F.min("cell") < F.max("cell")).alias("x")).agg(F.count_if("x")).first()[0]
    if crossing:
        raise ValueError(f"clusters in several cells: {crossing}")
    return out


def _transform(sums: np.ndarray) -> np.ndarray:
    """From raw columns to BASIS, with means, deviations and shares of the training rows."""
    n, regular = sums[0, 0], sums[0, 5]
    if n == 0 or min(regular - sums[0, 3] - sums[0, 4], sums[0, 3], sums[0, 4]) <= 0:
        raise ValueError("a government level is missing in training")
    out = np.zeros((len(RAW), len(BASIS)))
    out[0, 0] = 1
    for raw, at in ((1, 1), (2, 4)):
        mean = sums[0, raw] / n
        var = sums[raw, raw] / n - mean * mean
        if var <= 1e-12 * max(mean * mean, 1):
            raise ValueError("a covariate is constant in training")
        out[0, at], out[raw, at] = -mean / math.sqrt(var), 1 / math.sqrt(var)
    for raw, at in ((3, 2), (4, 3)):
        out[raw, at], out[5, at] = 1, -sums[0, raw] / regular
    return out


def _least_squares(s: TrainingSet, name: str) -> tuple[np.ndarray, float, int]:
    use, n = s.transform[:, terms(name)], int(round(s.sums[0, 0]))
    xx, xy, yy = use.T @ s.sums[:6, :6] @ use, use.T @ s.sums[:6, 6], s.sums[6, 6]
    if n <= len(xx) + 2 or np.linalg.matrix_rank(xx) < len(xx):
        raise ValueError("the design lacks rank")
    beta = np.linalg.solve(xx, xy)
    return beta, max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0), n


def _trial(x: np.ndarray, w: np.ndarray, ly: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Minus the log likelihood, its gradient and the upper parts of the expected information, as sums over rows."""
    k = x.shape[1]
    with np.errstate(all="ignore"):
        ls, e = w @ theta[k:], ly - x @ theta[:k]
        v = np.exp(-2 * ls)
        value = np.sum(ly + ls + 0.5 * math.log(2 * math.pi) + 0.5 * e * e * v)
        info = (x.T * v) @ x
        return np.r_[value, -(x.T @ (e * v)), w.T @ (1 - e * e * v), info[np.triu_indices(k)], (2 * w.T @ w)[np.triu_indices(2)]]


def _unpacked(row: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    info, at = np.zeros((k + 2, k + 2)), k + 3
    for low, size in ((0, k), (k, 2)):
        upper = np.triu_indices(size)
        block = np.zeros((size, size))
        block[upper] = row[at : at + len(upper[0])]
        info[low : low + size, low : low + size] = block + np.triu(block, 1).T
        at += len(upper[0])
    return float(row[0]), np.array(row[1 : k + 3]), info


def _passed(rows: DataFrame, sets: list[TrainingSet], trials: list[tuple[int, str, np.ndarray]], cells: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """All trials (set, model, parameters) in one pass: tasks sum over their rows, then the sums of tasks are added."""
    width = 1 + 7 + 15 + 3
    member = np.zeros((len(sets), cells), bool)
    for i, s in enumerate(sets):
        member[i, s.cells] = True
    transforms = [s.transform for s in sets]
    by_set: dict[int, list[tuple[int, list[int], np.ndarray]]] = {}
    for t, (i, name, theta) in enumerate(trials):
        by_set.setdefault(i, []).append((t, terms(name), theta))
    count = len(trials)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((count, width))
        for batch in batches:
            cell, raw, ly = batch["cell"].to_numpy(), batch[list(RAW)].to_numpy(), np.log(batch["y"].to_numpy())
            for i, todo in by_set.items():
                use = member[i][cell]
                x, seen = raw[use] @ transforms[i], ly[use]
                for t, cols, theta in todo:
                    part = _trial(x[:, cols], x[:, :2], seen, theta)
                    total[t, : len(part)] += part
        out = pd.DataFrame(total, columns=[f"v{i}" for i in range(width)])
        out.insert(0, "trial", np.arange(count, dtype=np.int32))
        yield out

    schema = "trial int, " + ", ".join(f"v{i} double" for i in range(width))
    added = rows.select("cell", "y", *RAW).mapInPandas(reduced, schema).groupBy("trial").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(width)))
    found = {r[0]: np.array(r[1:], float) for r in added.collect()}
    return [_unpacked(found[t], len(terms(name))) for t, (_, name, _) in enumerate(trials)]


def _fits(rows: DataFrame, sets: list[TrainingSet], cells: int, most: int) -> tuple[dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], int]:
    """Location and scale coefficients of each set's models, and the passes that they took."""
    out, searches = {}, {}
    for i, s in enumerate(sets):
        for name in s.models:
            beta, rss, n = _least_squares(s, name)
            if scaled(name):
                searches[i, name] = model.starts(beta, rss, n, s.sums[0, 6] / n, 2)
            else:
                out[i, name] = beta, np.array([0.5 * math.log(max(rss, 1e-300) / n), 0.0])
    passes = 0
    while passes <= most:
        turns = [(key, s, ts) for key, both in searches.items() for s in both if (ts := s.tries())]
        if not turns:
            break
        found = iter(_passed(rows, sets, [(*key, t) for key, _, ts in turns for t in ts], cells))
        for _, s, ts in turns:
            s.take(ts, [next(found) for _ in ts])
        passes += 1
    for (i, name), both in searches.items():
        best, _ = model.best_of(both)
        k = len(terms(name))
        out[i, name] = best.at[:k], best.at[k:]
    return out, passes


def scored(rows: DataFrame, sets: list[TrainingSet], fits: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Each row's forecasts by all models of the sets that hold it out. The table of models is broadcast: folds and models bound it."""
    params = []
    for (i, name), (beta, gamma) in fits.items():
        s = sets[i]
        b, g = s.transform[:, terms(name)] @ beta, s.transform[:2, :2] @ gamma
        params += [(c, s.stage, s.context, name, *map(float, b), *map(float, g)) for c in s.held]
    names = [f"b{i}" for i in range(len(RAW))]
    table = rows.sparkSession.createDataFrame(params, "cell int, stage string, context string, model string, " + ", ".join(f"{n} double" for n in [*names, "g0", "g1"]))
    mu = sum((F.col(n) * F.col(c) for n, c in zip(names, RAW, strict=True)), F.lit(0.0))
    return model.forecasts(rows.join(F.broadcast(table), "cell"), mu, F.exp(F.col("g0") + F.col("g1") * F.col("lq")), "y")


_SUMS = ("n", "score", "error", "inside", "below", "above", "mean", "seen", "nat_n", "nat_error", "nat_inside", "nat_mean", "nat_seen")


def _by_cluster(rows: DataFrame) -> DataFrame:
    national = F.col("national") == 1.0
    error, inside = F.abs(F.col("y") - F.col("median")), F.col("y").between(F.col("p10"), F.col("p90")).cast("double")
    values = {"n": F.lit(1.0), "score": F.col("log_score"), "error": error, "inside": inside, "below": (F.col("y") < F.col("p10")).cast("double"), "above": (F.col("y") > F.col("p90")).cast("double"), "mean": F.col("mean"), "seen": F.col("y")}
    aggs = [F.sum(v).alias(k) for k, v in values.items()] + [F.coalesce(F.sum(F.when(national, values[k])), F.lit(0.0)).alias(f"nat_{k}") for k in ("n", "error", "inside", "mean", "seen")]
    return rows.groupBy("stage", "context", "cluster", "model").agg(*aggs)


def _spreads(sums: DataFrame) -> dict[tuple[str, str], tuple[float, int, np.ndarray]]:
    """For each stage and context the rows, the clusters, and sums over clusters of products of (rows, score over M1's by model)."""
    every = MODELS + ABLATIONS
    wide = sums.groupBy("stage", "context", "cluster").pivot("model", list(every)).agg(F.first("score")).join(sums.filter("model = 'M1'").select("stage", "context", "cluster", "n"), ["stage", "context", "cluster"])
    cols = [F.col("n"), *(F.coalesce(F.col(m) - F.col("M1"), F.lit(0.0)) for m in every)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    out = {}
    for r in wide.groupBy("stage", "context").agg(F.sum("n"), F.count(F.lit(1)), F.array(*(F.sum(cols[i] * cols[j]) for i, j in pairs)), F.array(*(F.sum(c) for c in cols))).collect():
        v = np.zeros((len(cols), len(cols)))
        for (i, j), x in zip(pairs, r[4], strict=True):
            v[i, j] = v[j, i] = x
        out[r[0], r[1]] = r[2], r[3], v, np.array(r[5])
    return out


def paired(spread: tuple[float, int, np.ndarray, np.ndarray], left: str, right: str) -> dict:
    """Mean difference of scores with its cluster-robust standard error (null for a single cluster)."""
    n, clusters, products, sums = spread
    at = {m: i + 1 for i, m in enumerate(MODELS + ABLATIONS)}
    way = np.zeros(len(sums))
    way[at[left]] += 1
    way[at[right]] -= 1
    gain = float(way @ sums) / n
    way[0] -= gain
    se = math.sqrt(max(clusters / (clusters - 1) * float(way @ products @ way), 0.0)) / n if clusters > 1 else None
    low, high = (None, None) if se is None else (gain - 1.96 * se, gain + 1.96 * se)
    return {"gain": gain, "cluster_se": se, "low": low, "high": high, "n": int(n), "clusters": int(clusters)}


def _guarded(own: dict, base: dict) -> bool:
    """Among national rows: error, coverage and bias not much worse than M1's. Without such rows, none is guarded."""
    if not own["nat_n"] or not own["nat_seen"]:
        return False
    mae, coverage, bias = (lambda s: s["nat_error"] / s["nat_n"]), (lambda s: s["nat_inside"] / s["nat_n"]), (lambda s: abs(100 * (s["nat_mean"] / s["nat_seen"] - 1)))
    return mae(own) <= GUARD_MAE * mae(base) and coverage(own) >= coverage(base) - GUARD_COVERAGE and bias(own) <= bias(base) + GUARD_BIAS


def choose(context: str, sums: dict[str, dict], spread) -> list[dict]:
    """The simplest model within one paired standard error of the best that passes the guard.

    If no competitive model passes it, the simplest that does is taken, and the audit says so.
    """
    score = {m: sums[m]["score"] / sums[m]["n"] for m in MODELS[1:]}
    best = max(MODELS[1:], key=score.get)
    audit = []
    for m in MODELS[1:]:
        tolerance = paired(spread, best, m)["cluster_se"] or 0.0
        audit.append({"context": context, "model": m, "best": best, "log_score": score[m], "tolerance": tolerance, "competitive": score[best] - score[m] <= tolerance + 1e-12, "guarded": _guarded(sums[m], sums["M1"]), "parameters": len(terms(m)) + 2})
    fallback = not any(a["competitive"] and a["guarded"] for a in audit)
    open_to = [a for a in audit if a["guarded"] and (fallback or a["competitive"])]
    if not open_to:
        raise ValueError(f"no model passes the guard in {context}")
    chosen = min(open_to, key=lambda a: (a["parameters"], -a["log_score"], a["model"]))["model"]
    return [a | {"selected": a["model"] == chosen, "fallback": fallback} for a in audit]


def _metrics(name: str, s: dict) -> dict:
    n, mean, seen = s["n"], s["mean"] / s["n"], s["seen"] / s["n"]
    return {"model": name, "n": int(n), "clusters": int(s["clusters"]), "log_score": s["score"] / n, "mae": s["error"] / n, "macro_mae": s["macro"] / s["clusters"], "observed": seen, "predicted": mean, "bias_pct": 100 * (mean / seen - 1), "coverage": s["inside"] / n, "below": s["below"] / n, "above": s["above"] / n}


def select(df: DataFrame, outer: str, inner: str, cluster: str, y: str, folds: int = 3, most: int = 60) -> Selection:
    """Selects a model in each outer fold's training rows and in all rows, by inner folds; scores all on outer folds.

    df holds q, amount, government, y, the cluster and both folds (0 to folds - 1). No cluster
    may lie in several cells. Refused, with ValueError: an empty table, rows without a fold,
    outcomes or amounts that aren't positive, training rows without a government level or with
    a constant covariate. Ties go to the model with fewer parameters, then by name.
    """
    rows = raw_rows(df, outer, inner, cluster, y, folds).persist()
    cells = folds * folds
    by = None
    try:
        moments = _moments(rows, folds)
        sets = training_sets(folds)
        for s in sets:
            s.sums = moments[s.cells].sum(axis=0)
            s.transform = _transform(s.sums)
        fits, passes = _fits(rows, sets, cells, most)
        by = _by_cluster(scored(rows, sets, fits)).persist()
        added = by.groupBy("stage", "context", "model").agg(*(F.sum(c).alias(c) for c in _SUMS), F.count(F.lit(1)).alias("clusters"), F.sum(F.col("error") / F.col("n")).alias("macro")).collect()
        spreads = _spreads(by)
    finally:
        rows.unpersist()
        if by is not None:
            by.unpersist()
    sums = {(r.stage, r.context, r.model): r.asDict() for r in added}
    contexts = [f"outer_{c}" for c in range(folds)]
    audit = [a for c in [*contexts, ALL] for a in choose(c, {m: sums["inner", c, m] for m in MODELS}, spreads["inner", c])]
    chosen = {a["context"]: a["model"] for a in audit if a["selected"]}
    united = lambda pick: {k: sum(sums["outer", c, pick(c)][k] for c in contexts) for k in (*_SUMS, "clusters", "macro")}
    metrics = [_metrics(m, united(lambda _, m=m: m)) for m in MODELS + ABLATIONS] + [_metrics("selected", united(chosen.get))]
    whole = tuple(sum(spreads["outer", c][i] for c in contexts) for i in range(4))
    return Selection(audit, [{"left": a, "right": b, **paired(whole, a, b)} for a, b in CONTRASTS], metrics, passes)

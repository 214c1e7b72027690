"""Conditional lognormal models, hurdle mixtures, their forecasts and scores.

Sums over rows are taken in Spark, in one aggregate for each step; what is solved on the
driver has as many rows as the design has columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z10 = NormalDist().inv_cdf(0.9)
REGULAR = ("local", "regional", "national")

#: Location columns of each model; the scale of TOTAL and of the last phase uses zq in all but M0.
DESIGNS = {
    "M0": ["one"],
    "M1": ["one", "zq"],
    "M2": ["one", "zq", "regional_c", "national_c"],
    "M3": ["one", "zq", "zamount"],
    "M4": ["one", "zq", "regional_c", "national_c", "zamount"],
}


def covariates(df: DataFrame, train: Column | None = None) -> DataFrame:
    """Adds one, zq, zamount, regional_c and national_c. Means, deviations (population) and shares are those of training rows."""
    use = F.lit(True) if train is None else train
    pick = lambda c: F.when(use, c)
    lq, la = F.log1p(F.col("q").cast("double")), F.log(F.col("amount"))
    regular = F.col("government").isin(*REGULAR)
    one = df.agg(
        F.avg(pick(lq)).alias("_mq"), F.stddev_pop(pick(lq)).alias("_sq"), F.avg(pick(la)).alias("_ma"), F.stddev_pop(pick(la)).alias("_sa"),
        F.avg(pick(F.when(regular, (F.col("government") == "regional").cast("double")))).alias("_wr"), F.avg(pick(F.when(regular, (F.col("government") == "national").cast("double")))).alias("_wn"),
    )
    out = df.crossJoin(F.broadcast(one))
    contrast = lambda level, w: F.when(regular, (F.col("government") == level).cast("double") - F.col(w)).otherwise(0.0)
    return out.withColumns({"one": F.lit(1.0), "zq": (lq - F.col("_mq")) / F.col("_sq"), "zamount": (la - F.col("_ma")) / F.col("_sa"), "regional_c": contrast("regional", "_wr"), "national_c": contrast("national", "_wn")}).drop("_mq", "_sq", "_ma", "_sa", "_wr", "_wn")


def _sums(df: DataFrame, columns: list[str], y: Column, weight: Column) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'WX, X'Wy, y'Wy and the number of rows."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    one = df.agg(*(F.sum(weight * F.col(columns[i]) * F.col(columns[j])) for i, j in pairs), *(F.sum(weight * F.col(c) * y) for c in columns), F.sum(weight * y * y), F.count(F.lit(1))).first()
    xx = np.zeros((k, k))
    for (i, j), v in zip(pairs, one, strict=False):
        xx[i, j] = xx[j, i] = v
    at = len(pairs)
    return xx, np.array(one[at : at + k], float), float(one[at + k]), int(one[at + k + 1])


def fit_constant(df: DataFrame, columns: list[str], y: str) -> tuple[np.ndarray, float]:
    """Location coefficients and log sigma, whose maximum is in closed form."""
    xx, xy, yy, n = _sums(df, columns, F.log(F.col(y)), F.lit(1.0))
    if np.linalg.matrix_rank(xx) < len(columns):
        raise ValueError("the design lacks rank")
    beta = np.linalg.solve(xx, xy)
    rss = yy - 2 * beta @ xy + beta @ xx @ beta
    return beta, 0.5 * math.log(max(rss, 1e-300) / n)


def linear(columns: list[str], beta) -> Column:
    out = F.lit(0.0)
    for c, b in zip(columns, beta, strict=True):
        out = out + F.col(c) * float(b)
    return out


# Where coefficients may lie (the intercept, then the others), of the location and of the log scale.
BOUNDS = {"location": ((-20.0, 20.0), (-5.0, 5.0)), "scale": ((-6.0, 4.0), (-3.0, 3.0))}
#: Shares of a step that a pass tries, how near a bound a maximum may lie, and the gain in log likelihood that counts as none.
TRIED, INTERIOR, GAIN = (1.0, 0.5, 0.1), 1e-5, 1e-10


@dataclass(frozen=True)
class Fit:
    """A conditional lognormal model: log y has mean location . beta and log deviation scale . gamma."""

    location: tuple[str, ...]
    scale: tuple[str, ...]
    beta: np.ndarray
    gamma: np.ndarray
    loglik: float
    n: int
    steps: int
    starts: int


def _bounds(k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [BOUNDS["location"][min(i, 1)] for i in range(k)] + [BOUNDS["scale"][min(i, 1)] for i in range(m)]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def _passed(df: DataFrame, location: list[str], scale: list[str], y: str, points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Minus the log likelihood at each point, its gradient and the expected information, all from one aggregate."""
    k, m = len(location), len(scale)
    ly, total, aggs = F.log(F.col(y)), lambda c: F.sum(c), []
    for theta in points:
        ls, e = linear(scale, theta[k:]), ly - linear(location, theta[:k])
        v = F.exp(-2 * ls)
        aggs += [total(ly + ls + 0.5 * math.log(2 * math.pi) + 0.5 * e * e * v), *(total(-F.col(c) * e * v) for c in location), *(total(F.col(c) * (1 - e * e * v)) for c in scale)]
        aggs += [total(F.col(location[i]) * F.col(location[j]) * v) for i in range(k) for j in range(i, k)] + [total(2 * F.col(scale[i]) * F.col(scale[j])) for i in range(m) for j in range(i, m)]
    row, out, each = list(df.agg(*aggs).first()), [], len(aggs) // len(points)
    for at in range(0, len(row), each):
        part = iter(row[at : at + each])
        value, gradient, info = next(part), np.array([next(part) for _ in range(k + m)], float), np.zeros((k + m, k + m))
        for low, size in ((0, k), (k, m)):
            for i in range(size):
                for j in range(i, size):
                    info[low + i, low + j] = info[low + j, low + i] = next(part)
        out.append((float(value), gradient, info))
    return out


class Search:
    """One start's way to a maximum of the likelihood within a box: each turn tries several shares of a scoring step."""

    def __init__(self, start: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high
        self.at, self.now, self.done = np.clip(start, low + 1e-4, high - 1e-4), None, False

    def gain(self) -> float:
        """What a scoring step would gain: half of the squared length of the gradient, measured by the information."""
        _, gradient, info = self.now
        return abs(gradient @ np.linalg.lstsq(info, gradient, rcond=None)[0]) / 2

    def tries(self) -> list[np.ndarray]:
        if self.done or self.now is None:
            return [] if self.done else [self.at]
        _, gradient, info = self.now
        move = np.linalg.lstsq(info, -gradient, rcond=None)[0]
        return [np.clip(self.at + share * move, self.low, self.high) for share in TRIED]

    def take(self, tried: list[np.ndarray], found: list[tuple[float, np.ndarray, np.ndarray]]) -> None:
        sound = [j for j, f in enumerate(found) if all(np.isfinite(x).all() for x in f)]
        if not sound:
            self.done = True
            return
        j = min(sound, key=lambda j: found[j][0])
        first, value = self.now is None, found[j][0]
        # Values are sums over all rows, known to their rounding; the gradient tells when to end.
        stuck = not first and (value > self.now[0] + 1e-12 * abs(value) or np.allclose(tried[j], self.at, rtol=0, atol=1e-13))
        if not stuck:
            self.at, self.now = tried[j], found[j]
        self.done = stuck or self.gain() <= GAIN

    def good(self) -> bool:
        inside = (self.at > self.low + INTERIOR).all() and (self.at < self.high - INTERIOR).all()
        return self.done and self.now is not None and bool(inside) and self.gain() <= 100 * GAIN


def starts(beta: np.ndarray, rss: float, n: int, mean: float, scales: int) -> list[Search]:
    """Two starts: least squares, and a location that is the mean alone."""
    k, spread = len(beta), 0.5 * math.log(max(rss / n, 0.05**2))
    low, high = _bounds(k, scales)
    return [Search(np.r_[b, spread, np.zeros(scales - 1)], low, high) for b in (beta, np.r_[mean, np.zeros(k - 1)])]


def best_of(searches: list[Search]) -> tuple[Search, int]:
    """The better of the starts that gain nothing more and end inside the box, and how many do."""
    good = [s for s in searches if s.good()]
    if not good:
        raise RuntimeError("no start ends inside the bounds")
    return min(good, key=lambda s: s.now[0]), len(good)


def fit_scaled(df: DataFrame, location: list[str], scale: list[str], y: str, most: int = 60) -> Fit:
    """The maximum of the likelihood within BOUNDS, from two starts.

    Each step is one aggregate over the rows, in which both starts try several shares of their
    scoring step; a step that leaves the box ends at its border. Refused are outcomes that
    aren't positive, designs that lack rank, and searches that end at a border or not at all.
    """
    k, m, ly = len(location), len(scale), F.log(F.col(y))
    xx, xy, yy, n = _sums(df, location, ly, F.lit(1.0))
    odd, mean = df.agg(F.count_if(~F.coalesce(F.col(y) > 0, F.lit(False))), F.avg(ly)).first()
    if odd:
        raise ValueError("outcomes must be positive")
    if n <= k + m or np.linalg.matrix_rank(xx) < k:
        raise ValueError("the design lacks rank")
    beta = np.linalg.solve(xx, xy)
    searches, steps = starts(beta, yy - 2 * beta @ xy + beta @ xx @ beta, n, mean, m), -1
    while steps < most and any(tries := [s.tries() for s in searches]):
        steps += 1
        found = iter(_passed(df, location, scale, y, [t for ts in tries for t in ts]))
        for s, ts in zip(searches, tries, strict=True):
            if ts:
                s.take(ts, [next(found) for _ in ts])
    best, good = best_of(searches)
    return Fit(tuple(location), tuple(scale), best.at[:k], best.at[k:], -best.now[0], n, steps, good)


def sandwich(df: DataFrame, fit: Fit, y: str, cluster: str) -> tuple[np.ndarray, int]:
    """Cluster-robust covariance of location and scale coefficients together, and the number of clusters.

    The bread is the observed information, with the terms that join location and scale; the
    meat is of whole clusters' scores. One aggregate gives the one, a sum by cluster the other.
    """
    names = [*fit.location, *fit.scale]
    k, p = len(fit.location), len(names)
    ls, e = linear(list(fit.scale), fit.gamma), F.log(F.col(y)) - linear(list(fit.location), fit.beta)
    v = F.exp(-2 * ls)
    weight = lambda i, j: v if j < k else 2 * e * v if i < k else 2 * e * e * v
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    info = np.zeros((p, p))
    for (i, j), x in zip(pairs, df.agg(*(F.sum(F.col(names[i]) * F.col(names[j]) * weight(i, j)) for i, j in pairs)).first(), strict=True):
        info[i, j] = info[j, i] = x
    if np.linalg.matrix_rank(info) < p:
        raise ValueError("the information lacks rank")
    score = lambda i: F.col(names[i]) * (e * v if i < k else e * e * v - 1)
    sums = df.groupBy(cluster).agg(*(F.sum(score(i)).alias(f"s{i}") for i in range(p)))
    row = sums.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs), F.count(F.lit(1))).first()
    meat, g = np.zeros((p, p)), row[len(pairs)]
    for (i, j), x in zip(pairs, row, strict=False):
        meat[i, j] = meat[j, i] = x
    if g < 2:
        raise ValueError("one cluster has no spread")
    bread = np.linalg.inv(info)
    return bread @ meat @ bread * g / (g - 1), g


def forecasts(df: DataFrame, mu: Column, sigma: Column, y: str) -> DataFrame:
    """Mean, median, P10, P90 and log density of the observed value."""
    v = F.col(y).cast("double")
    z = (F.log(v) - mu) / sigma
    density = F.when(v > 0, -F.log(v) - F.log(sigma) - 0.5 * math.log(2 * math.pi) - z * z / 2)
    return df.withColumns({"mean": F.exp(mu + sigma * sigma / 2), "median": F.exp(mu), "p10": F.exp(mu - Z10 * sigma), "p90": F.exp(mu + Z10 * sigma), "log_score": density})


def scores(y: str) -> list[Column]:
    """MAE of the median, bias in days and percent, coverage and tails of P10..P90, mean log score (null if any row lacks one), rows without one."""
    v = F.col(y).cast("double")
    bare = F.count_if(F.col("log_score").isNull())
    return [
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(v - F.col("median"))).alias("mae"), F.avg(F.col("mean") - v).alias("bias"), (100 * F.avg(F.col("mean") - v) / F.nullif(F.avg(v), F.lit(0.0))).alias("bias_pct"),
        F.avg(v.between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"), F.avg((v < F.col("p10")).cast("double")).alias("below"), F.avg((v > F.col("p90")).cast("double")).alias("above"),
        F.when(bare == 0, F.avg("log_score")).alias("log_score"), bare.alias("unsupported"),
    ]


def cluster_difference(df: DataFrame, difference: str, cluster: str) -> DataFrame:
    """Mean difference with its cluster-robust standard error and 95 % interval."""
    n, mean = F.count(F.lit(1)), F.avg(difference)
    one = df.agg(n.alias("n"), mean.alias("mean"))
    sums = df.crossJoin(F.broadcast(one)).groupBy(cluster, "n", "mean").agg(F.sum(F.col(difference) - F.col("mean")).alias("s"))
    g = F.count(F.lit(1)).cast("double")
    se = F.sqrt(g / F.nullif(g - 1, F.lit(0.0)) * F.sum(F.col("s") * F.col("s"))) / F.first("n")
    return sums.agg(F.first("n").alias("n"), g.cast("long").alias("clusters"), F.first("mean").alias("difference"), se.alias("se")).withColumns({"low": F.col("difference") - 1.96 * F.col("se"), "high": F.col("difference") + 1.96 * F.col("se")})


def student_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by halving on its distribution function."""
    if p < 0.5:
        return -student_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while _student_cdf(high, df) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _student_cdf(t: float, df: float) -> float:
    return 1 - _beta_ratio(df / (df + t * t), df / 2, 0.5) / 2


def _beta_ratio(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction evaluated from the inside out."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_ratio(1 - x, b, a)
    tail = 1.0
    for i in range(300, 0, -1):
        m = i // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1 + d / tail
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a / tail


def binomial_quantile(p: float, n: int, q: float) -> int:
    """Smallest k with P(X <= k) >= p of n trials of probability q, for any n: by halving on the incomplete beta function."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        below = 1.0 if mid >= n else _beta_ratio(1 - q, n - mid, mid + 1)
        low, high = (low, mid) if below >= p else (mid + 1, high)
    return low

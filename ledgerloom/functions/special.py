"""Tail probabilities as column expressions, without Python in the rows.

Series and continued fractions are folded over a fixed number of terms, so a value's cost is
bounded whatever its degrees of freedom.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a continued fraction or series. Beyond LARGE degrees of freedom Student's t is turned into a normal score, whose error is below 1e-9 there.
TERMS, LARGE = 260, 5000.0


def _fold(start: Column, terms: int, step, down: bool = False) -> Column:
    """step(value, k) over k = 1 .. terms, or downwards."""
    ks = F.sequence(F.lit(terms), F.lit(1), F.lit(-1)) if down else F.sequence(F.lit(1), F.lit(terms))
    return F.aggregate(ks, start, lambda value, k: step(value, k.cast("double")))


def normal_tails(z: Column) -> Column:
    """P(|Z| > z) for z >= 0."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    # Near the centre a power series of the distribution function, outside a continued fraction of the tail.
    term = F.struct(z.alias("s"), z.alias("t"))
    grown = lambda v, k: F.struct((v["s"] + v["t"] * z * z / (2 * k + 1)).alias("s"), (v["t"] * z * z / (2 * k + 1)).alias("t"))
    inner = 1 - 2 * density * _fold(term, 60, grown)["s"]
    outer = 2 * density / _fold(z, 60, lambda v, k: z + k / v, down=True)
    return F.when(z < 3, F.greatest(inner, F.lit(0.0))).otherwise(outer)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    stirling = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    down = x
    for i in range(1, 8):
        down = down * (x + i)
    return stirling - F.log(down)


def _beta_part(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) where x is on the side on which its continued fraction converges fast."""

    def step(v: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / v

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
    return front / _fold(F.lit(1.0), TERMS, step, down=True)


def beta_ratio(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), for positive a and b."""
    near = x <= (a + 1) / (a + b + 2)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(near, _beta_part(x, a, b)).otherwise(1 - _beta_part(1 - x, b, a))


def student_tails(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t; null for nulls and for no degrees of freedom."""
    t, df = F.abs(t), df.cast("double")
    few = F.least(df, F.lit(LARGE))
    small = beta_ratio(few / (few + t * t), few / 2, F.lit(0.5))
    score = (8 * df + 1) / (8 * df + 3) * F.sqrt(df * F.log1p(t * t / df))
    return F.when((df > 0) & t.isNotNull(), F.when(t == float("inf"), 0.0).when(df <= LARGE, small).otherwise(normal_tails(score)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs; null for fewer than three."""
    df = (n - 2).cast("double")
    left = F.greatest(1 - r * r, F.lit(0.0))
    t = F.when(left > 0, F.abs(r) * F.sqrt(df / left)).otherwise(F.lit(float("inf")))
    return F.when((n > 2) & r.isNotNull(), student_tails(t, df))

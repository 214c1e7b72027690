"""Precise sizes are accepted only if they agree with larger ones."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import special
from ledgerloom.operators import model, simulate


def table(spark, shift, leave=()):
    """Four replicates of two sizes, all within their tolerances; the means of the smaller are off by `shift` tolerances."""
    rows = [(n, r, m, 10.0 + 0.001 * r + (shift if n == 1000 else 0.0), 0.5, 1.0, True) for n in (1000, 5000) for r in range(4) for m in simulate.METRICS]
    rows = [x for x in rows if x[:3] not in leave]
    return spark.createDataFrame(rows, "size int, rep long, metric string, estimate double, halfwidth double, tolerance double, passes boolean")


def decided(df, sizes, replicates=4):
    names = ("size", "passing", "stable", "accepted", "recommended", "status", "confirmed")
    return [tuple(r[c] for c in names) for r in simulate.decide(df, sizes, replicates).orderBy("size").collect()]


def test_precise_but_unstable(spark):
    yes, no = ("PRECISION_REACHED", True), ("PRECISION_REACHED", False)
    assert decided(table(spark, 0.5), [1000, 5000]) == [(1000, 4, True, True, True, *yes), (5000, 4, True, True, False, *yes)]
    # The only accepted size is the largest: nothing confirms it.
    assert decided(table(spark, 2.0), [1000, 5000]) == [(1000, 4, False, False, False, *no), (5000, 4, True, True, True, *no)]
    # Within the tolerance, but not with Welch's margin.
    assert not decided(table(spark, 0.999), [1000, 5000])[0][2]


def test_welch_margin_is_that_of_the_quantile(spark):
    """On both sides of the border that Student's 97.5 % quantile gives."""
    rows = lambda n, mean: [(n, r, m, mean + 0.01 * (r - 1.5) * (1 + n / 2000), 0.5, 1.0) for r in range(4) for m in simulate.METRICS]
    spread = lambda n: 0.01**2 * (1 + n / 2000) ** 2 * 5 / 3 / 4  # noqa: E731  the variance of -1.5 .. 1.5 is 5/3
    a, b = spread(1000), spread(5000)
    margin = model.student_quantile(0.975, (a + b) ** 2 / ((a * a + b * b) / 3)) * (a + b) ** 0.5
    for nudge, stable in ((-1e-6, True), (1e-6, False)):
        df = spark.createDataFrame(rows(1000, 10.0) + rows(5000, 11.0 - margin + nudge), "size int, rep long, metric string, estimate double, halfwidth double, tolerance double")
        assert decided(df, [1000, 5000])[0][2] is stable


def test_a_tenth_may_fail_and_infinite_widths_do(spark):
    bad = lambda df, k: df.withColumn("halfwidth", F.when((F.col("rep") < k) & (F.col("metric") == "p95"), float("inf")).otherwise(F.col("halfwidth")))
    rows = [(n, r, m, 10.0, 0.5, 1.0) for n in (1000, 5000) for r in range(30) for m in simulate.METRICS]
    df = spark.createDataFrame(rows, "size int, rep long, metric string, estimate double, halfwidth double, tolerance double")
    assert [x[3] for x in decided(bad(df, 3), [1000, 5000], 30)] == [True, True]
    assert [x[3:] for x in decided(bad(df, 4), [1000, 5000], 30)] == [(False, False, "PRECISION_NOT_REACHED", False)] * 2


def measured(spark, values):
    df = spark.createDataFrame([(0, float(v)) for v in values], "rep long, total double")
    return {r["metric"]: r for r in simulate.precision(df, len(values)).collect()}


def test_half_widths_by_hand(spark):
    # 1000 values 1..1000; ranks of the 90 % quantile are 881 and 919, its estimate 900.1.
    got = measured(spark, range(1, 1001))
    assert simulate.quantile_ranks(1000, 0.9) == (881, 919)
    assert got["p90"]["halfwidth"] == pytest.approx(900.1 - 881)
    # A share of 0.0055 of 1000 would pass by Wilson's radius alone; the distance to the farther bound is 0.00684.
    assert measured(spark, [200.0] * 11 + [1.0] * 1989)["over_180"]["halfwidth"] == pytest.approx(0.00432, abs=1e-5)
    assert measured(spark, [1.0] * 1000)["over_180"]["halfwidth"] == pytest.approx(0.0038268, abs=1e-6)
    # Few values have no order statistic beyond the quantile; constants have no spread.
    few = measured(spark, [1.0, 2.0, 3.0])
    assert few["p95"]["halfwidth"] == float("inf") and not few["p95"]["passes"]
    same = measured(spark, [12.0] * 1000)
    assert (same["mean"]["estimate"], same["sd"]["halfwidth"], same["sd"]["passes"]) == (12.0, 0.0, True)
    # A two-point sample has m4 = s^4 but for rounding, whose sign must not matter.
    assert measured(spark, [0.0, 1.0] * 500)["sd"]["halfwidth"] == pytest.approx(0.0, abs=1e-3)
    # Negative totals: tolerances are of the size of the estimate.
    assert measured(spark, [-100.0 - i for i in range(1000)])["mean"]["tolerance"] == pytest.approx(0.005 * 599.5)


@pytest.mark.parametrize("df", [1, 2, 3.7, 10, 57.5, 1000, 4999, 5001, 84_701, 10**9])
def test_student_tails(spark, df):
    ts = [0.0, 1e-6, 0.1, 0.7, 1.0, 1.96, 2.5, 3.1, 4.5, 7.0]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in ts], "t double").select(special.student_tails(F.col("t"), F.lit(float(df)))).collect()]
    for t, p in zip(ts, got, strict=True):
        assert p == pytest.approx(tails(t, df), rel=1e-6, abs=1e-12)


def tails(t, df):
    """By Simpson's rule over the angle, whose density is a power of the cosine."""
    start = math.atan(t / math.sqrt(df))
    end = min(math.pi / 2, start + 60 / math.sqrt(df))
    u = np.linspace(start, end, 400_001)
    f = np.exp((df - 1) * np.log(np.maximum(np.cos(u), 1e-300)))
    # ln of the ratio of gamma functions, by their asymptotic series where lgamma would cancel.
    ratio = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) if df < 1e5 else 0.5 * math.log(df / 2) - 1 / (4 * df)
    w = np.ones_like(u)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return 2 * math.exp(ratio) / math.sqrt(math.pi) * float((w * f).sum()) * (u[1] - u[0]) / 3


def test_incomplete_tables_are_refused(spark):
    with pytest.raises(ValueError):
        simulate.decide(table(spark, 0.0, {(1000, 2, "p95")}), [1000, 5000], 4)
    with pytest.raises(ValueError):
        simulate.decide(table(spark, 0.0), [1000, 5000, 10000], 4)
    with pytest.raises(ValueError):
        simulate.decide(table(spark, 0.0).withColumn("tolerance", F.lit(0.0)), [1000, 5000], 4)

"""Fits and their standard errors against NumPy, and joins that check their contract."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import link, model


def sample(n=240, seed=3):
    rng = np.random.default_rng(seed)
    z, a = rng.normal(size=n), rng.normal(size=n)
    y = np.exp(3 - 0.3 * z + 0.2 * a + np.exp(-0.4 + 0.25 * z) * rng.normal(size=n))
    return z, a, y, np.arange(n) // 4


def frame(spark, z, a, y, cluster):
    return spark.createDataFrame([(1.0, float(p), float(q), float(r), int(c)) for p, q, r, c in zip(z, a, y, cluster, strict=True)], "one double, zq double, za double, y double, entity long")


def scores(theta, x, w, ly):
    e, v = ly - x @ theta[: x.shape[1]], np.exp(-2 * (w @ theta[x.shape[1] :]))
    return np.column_stack([x * (e * v)[:, None], w * (e * e * v - 1)[:, None]])


def newton(x, w, ly):
    """The root of the score by Newton's method with a differenced Jacobian, from the constant model."""
    theta = np.r_[np.linalg.lstsq(x, ly, rcond=None)[0], np.log((ly - ly.mean()).std()), np.zeros(w.shape[1] - 1)]
    for _ in range(50):
        theta = theta + 0.7 * np.linalg.solve(information(theta, x, w, ly), scores(theta, x, w, ly).sum(axis=0))
    return theta


def information(theta, x, w, ly, h=1e-5):
    steps = np.eye(len(theta)) * h
    out = np.column_stack([-(scores(theta + s, x, w, ly).sum(axis=0) - scores(theta - s, x, w, ly).sum(axis=0)) / (2 * h) for s in steps])
    return (out + out.T) / 2


def test_fit_and_sandwich_equal_numpy(spark):
    z, a, y, cluster = sample()
    x, w, ly = np.column_stack([np.ones_like(z), z, a]), np.column_stack([np.ones_like(z), z]), np.log(y)
    df = frame(spark, z, a, y, cluster)
    fit = model.fit_scaled(df, ["one", "zq", "za"], ["one", "zq"], "y")
    theta = newton(x, w, ly)
    assert np.allclose(np.r_[fit.beta, fit.gamma], theta, atol=1e-5)
    e, ls = ly - x @ theta[:3], w @ theta[3:]
    assert fit.loglik == pytest.approx(float(np.sum(-ly - ls - 0.5 * np.log(2 * np.pi) - 0.5 * (e * np.exp(-ls)) ** 2)), abs=1e-6)
    assert (fit.n, fit.starts) == (240, 2)
    cov, g = model.sandwich(df, fit, "y", "entity")
    sums = np.array([scores(theta, x, w, ly)[cluster == c].sum(axis=0) for c in range(60)])
    bread = np.linalg.inv(information(theta, x, w, ly))
    assert g == 60
    assert np.allclose(cov, bread @ (sums.T @ sums) @ bread * 60 / 59, rtol=1e-3, atol=1e-8)


def test_fits_that_are_refused(spark):
    z, a, y, cluster = sample(60)
    df = frame(spark, z, a, y, cluster)
    with pytest.raises(ValueError, match="rank"):
        model.fit_scaled(df.withColumn("twice", 2 * F.col("zq")), ["one", "zq", "twice"], ["one"], "y")
    with pytest.raises(ValueError, match="positive"):
        model.fit_scaled(df.withColumn("y", F.when(F.col("zq") > 1, 0.0).otherwise(F.col("y"))), ["one", "zq"], ["one"], "y")
    # The maximum lies at a slope of 9, beyond the bound of 5.
    with pytest.raises(RuntimeError, match="inside"):
        model.fit_scaled(df.withColumn("y", F.exp(9 * F.col("zq") + 0.1 * F.log("y"))), ["one", "zq"], ["one"], "y")
    with pytest.raises(ValueError, match="cluster"):
        model.sandwich(df.withColumn("entity", F.lit(1)), model.fit_scaled(df, ["one", "zq"], ["one"], "y"), "y", "entity")


def test_checked_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, r string")
    got = link.checked_join(left, right, ["k"], most=(0, 1))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x"), (2, "b", "y"), (2, "c", "y")]
    with pytest.raises(Exception, match="left_repeated 2"):
        link.checked_join(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="unmatched 2"):
        link.checked_join(left, right.filter("k <> 2"), ["k"], most=(0, 1)).collect()
    with pytest.raises(Exception, match="right_repeated 1"):
        link.checked_join(left, right.union(right), ["k"], "left", most=(0, 1)).collect()
    with pytest.raises(Exception, match="null_key null"):
        link.checked_join(left.union(spark.createDataFrame([(None, "n")], "k int, l string")), right, ["k"], most=(0, 1)).collect()
    faults = link.join_faults(left, right, ["k"])
    assert sorted(map(tuple, faults.collect())) == [(2, 2, 1, "left_repeated")]
    none = link.checked_join(left.limit(0), right, ["k"])
    assert none.count() == 0

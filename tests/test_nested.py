"""Nested selection against a plain NumPy version, its guard and its refusals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import nested


def sample(n=720, seed=5) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    q, amount = rng.integers(0, 60, n), np.exp(rng.normal(9, 1, n))
    level = rng.choice(["local", "regional", "national", "special"], n, p=[0.4, 0.25, 0.25, 0.1])
    z = (np.log1p(q) - 3.3) / 0.8
    mu = 4 - 0.3 * z + 0.35 * (level == "regional") - 0.3 * (level == "national") + 0.05 * (np.log(amount) - 9)
    total = np.exp(mu + np.exp(-0.7 + 0.2 * z) * rng.normal(size=n))
    entity = np.arange(n) // 8
    return pd.DataFrame({"q": q, "amount": amount, "government": level, "total": total, "entity": entity, "o": entity % 3, "i": entity // 3 % 3})


def design(d: pd.DataFrame, train: pd.DataFrame, name: str):
    lq, la = np.log1p(d.q.to_numpy(float)), np.log(d.amount.to_numpy())
    tq, ta = np.log1p(train.q.to_numpy(float)), np.log(train.amount.to_numpy())
    regular = train.government[train.government != "special"]
    cols = [np.ones(len(d))]
    z = (lq - tq.mean()) / tq.std()
    base = name.split("_")[0]
    if base != "M0" and "_" not in name:
        cols.append(z)
    if base in ("M2", "M4"):
        cols += [np.where(d.government == "special", 0, (d.government == g) - (regular == g).mean()) for g in ("regional", "national")]
    if base in ("M3", "M4"):
        cols.append((la - ta.mean()) / ta.std())
    free = "_" not in name and base != "M0"
    return np.column_stack(cols), np.column_stack([np.ones(len(d)), z]) if free else np.ones((len(d), 1))


def fitted(train: pd.DataFrame, name: str) -> np.ndarray:
    """Weighted least squares and a scoring step for the scale, turn by turn, until nothing moves."""
    x, w = design(train, train, name)
    ly = np.log(train.total.to_numpy())
    gamma = np.zeros(w.shape[1])
    for _ in range(500):
        v = np.exp(-2 * (w @ gamma))
        beta = np.linalg.solve((x.T * v) @ x, x.T @ (v * ly))
        e = ly - x @ beta
        step = np.linalg.solve(2 * w.T @ w, w.T @ (e * e * v - 1))
        gamma = gamma + step
        if np.abs(step).max() < 1e-12:
            break
    return np.r_[beta, gamma]


def held_out(train: pd.DataFrame, test: pd.DataFrame, name: str) -> pd.DataFrame:
    theta = fitted(train, name)
    x, w = design(test, train, name)
    k, ly = x.shape[1], np.log(test.total.to_numpy())
    mu, s = x @ theta[:k], np.exp(w @ theta[k:])
    out = test[["entity", "government", "total"]].copy()
    out["score"] = -ly - np.log(s) - 0.5 * math.log(2 * math.pi) - ((ly - mu) / s) ** 2 / 2
    out["median"], out["mean"], out["model"] = np.exp(mu), np.exp(mu + s * s / 2), name
    return out


def cluster_se(gain: pd.Series, entity: pd.Series) -> float:
    sums = (gain - gain.mean()).groupby(entity).sum()
    return math.sqrt(len(sums) / (len(sums) - 1) * (sums**2).sum()) / len(gain)


@pytest.fixture(scope="module")
def plain():
    return sample()


@pytest.fixture(scope="module")
def got(spark, plain):
    return nested.select(spark.createDataFrame(plain).repartition(3), "o", "i", "entity", "total")


def test_inner_scores_and_choice(got, plain):
    for context in ("outer_0", "outer_1", "outer_2", "all"):
        rows = plain if context == "all" else plain[plain.o != int(context[-1])]
        parts = {m: pd.concat([held_out(rows[rows.i != f], rows[rows.i == f], m) for f in range(3)]) for m in nested.MODELS[1:]}
        score = {m: p.score.mean() for m, p in parts.items()}
        best = max(score, key=score.get)
        audit = {a["model"]: a for a in got.audit if a["context"] == context}
        assert {a["best"] for a in audit.values()} == {best}
        near = []
        for m, p in parts.items():
            tolerance = cluster_se(parts[best].score - p.score, p.entity)
            assert audit[m]["log_score"] == pytest.approx(score[m], abs=1e-7)
            assert audit[m]["tolerance"] == pytest.approx(tolerance, abs=1e-7)
            assert audit[m]["competitive"] == (score[best] - score[m] <= tolerance + 1e-12)
            if audit[m]["competitive"] and audit[m]["guarded"]:
                near.append((audit[m]["parameters"], -score[m], m))
        assert [m for m, a in audit.items() if a["selected"]] == [min(near)[2]]


def test_contrasts_and_metrics(got, plain):
    parts = {m: pd.concat([held_out(plain[plain.o != c], plain[plain.o == c], m) for c in range(3)]) for m in nested.MODELS + nested.ABLATIONS}
    assert [(c["left"], c["right"]) for c in got.contrasts] == list(nested.CONTRASTS)
    assert len(got.contrasts) == 7
    for c in got.contrasts:
        gain = parts[c["left"]].score - parts[c["right"]].score
        assert c["gain"] == pytest.approx(gain.mean(), abs=1e-7)
        assert c["cluster_se"] == pytest.approx(cluster_se(gain, parts[c["left"]].entity), abs=1e-7)
        assert (c["n"], c["clusters"]) == (720, 90)
    metrics = {m["model"]: m for m in got.metrics}
    for m, p in parts.items():
        assert metrics[m]["log_score"] == pytest.approx(p.score.mean(), abs=1e-7)
        assert metrics[m]["mae"] == pytest.approx((p.total - p["median"]).abs().mean(), rel=1e-6)
        assert metrics[m]["macro_mae"] == pytest.approx((p.total - p["median"]).abs().groupby(p.entity).mean().mean(), rel=1e-6)
        assert metrics[m]["bias_pct"] == pytest.approx(100 * (p["mean"].mean() / p.total.mean() - 1), abs=1e-4)
    chosen = {a["context"]: a["model"] for a in got.audit if a["selected"]}
    own = pd.concat([held_out(plain[plain.o != c], plain[plain.o == c], chosen[f"outer_{c}"]) for c in range(3)])
    assert metrics["selected"]["log_score"] == pytest.approx(own.score.mean(), abs=1e-7)


def test_guard_and_fallback():
    base = {"n": 10.0, "score": -20.0, "nat_n": 4.0, "nat_error": 8.0, "nat_inside": 3.0, "nat_mean": 40.0, "nat_seen": 40.0}
    eye = np.eye(9) * 1e-12
    spread = (10.0, 5, eye, np.zeros(9))
    bad = base | {"score": -10.0, "nat_error": 9.0}
    audit = nested.choose("x", {"M1": base, "M2": bad, "M3": bad | {"score": -11.0}, "M4": bad}, spread)
    assert [(a["model"], a["guarded"], a["selected"], a["fallback"]) for a in audit] == [("M1", True, True, True), ("M2", False, False, True), ("M3", False, False, True), ("M4", False, False, True)]
    assert {a["best"] for a in audit} == {"M2"}
    for worse in ({"nat_inside": 2.7}, {"nat_mean": 44.1}, {"nat_error": 8.9}):
        assert not nested._guarded(base | worse, base)
    for near in ({"nat_inside": 2.9}, {"nat_mean": 43.9}, {"nat_error": 8.7}):
        assert nested._guarded(base | near, base)
    with pytest.raises(ValueError, match="guard"):
        nested.choose("x", dict.fromkeys(nested.MODELS, base | {"nat_n": 0.0}), spread)


def test_refusals(spark, plain):
    df = spark.createDataFrame(plain)
    run = lambda d: nested.select(d, "o", "i", "entity", "total")
    with pytest.raises(ValueError, match="positive"):
        run(df.withColumn("total", F.when(F.col("entity") == 3, 0.0).otherwise(F.col("total"))))
    with pytest.raises(ValueError, match="several cells"):
        run(df.withColumn("i", F.when(F.col("q") > 30, 0).otherwise(F.col("i"))))
    with pytest.raises(ValueError, match="level"):
        run(df.filter("government <> 'national'"))
    with pytest.raises(ValueError, match="constant"):
        run(df.withColumn("q", F.lit(4)))
    with pytest.raises(ValueError, match="fold"):
        run(df.withColumn("o", F.when(F.col("q") > 30, F.col("o"))))
    with pytest.raises(ValueError, match="level"):
        run(df.limit(0))

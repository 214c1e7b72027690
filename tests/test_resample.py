"""Bootstraps of whole clusters, in several blocks and runs, against copies that are really made."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import resample

REPS, CLUSTERS = 5, 123


def hits(seed, rep, g):
    top = (int(hashlib.md5(f"{seed}|{rep}|{slot}".encode()).hexdigest()[:12], 16) for slot in range(g))
    return [int((t + 0.5) / float(1 << 48) * g) for t in top]


@pytest.fixture
def small(monkeypatch):
    for name, size in (("BLOCK", 16), ("RUN", 2), ("SLOTS", 8)):
        monkeypatch.setattr(resample, name, size)


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    return [(c, rng.randint(1, 9), rng.randint(1, 40), rng.choice("ab")) for c in range(1000, 1000 + 7 * CLUSTERS, 7) for _ in range(rng.randint(1, 6))]


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, "c long, x long, y long, s string").repartition(3)


def copies(rows, seed, rep):
    clusters = sorted({r[0] for r in rows})
    return [r for h in hits(seed, rep, len(clusters)) for r in rows if r[0] == clusters[h]]


def test_sums_of_replicates(spark, df, rows, small):
    got = {r["rep"]: (r["n"], r["s"]) for r in resample.moments(df, "c", REPS, "m", {"n": (F.col("s") == "a").cast("double"), "s": F.when(F.col("s") == "a", F.col("y"))}).collect()}
    assert got == {k: (sum(r[3] == "a" for r in b), sum(r[2] for r in b if r[3] == "a")) for k in range(REPS) for b in [copies(rows, "m", k)]}


def test_draws_are_the_named_stream(spark, small):
    for g in (20, 99, CLUSTERS, 1005):
        got = {k: [] for k in range(REPS)}
        for r in resample.drawn(spark, g, REPS, "seed").collect():
            got[r["rep"]] += [16 * r["block"] + int(at) for at in np.frombuffer(r["hits"], "<u2")]
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(hits("seed", k, g)) for k in range(REPS)}
    assert resample.drawn(spark, 19, REPS, "seed").count() == 0


def test_correlations_of_replicates(spark, df, rows, small):
    def ranks(v):
        return [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]

    got = {r["rep"]: (r["pearson"], r["spearman"]) for r in resample.correlations(df, "c", REPS, "r", "x", "y").collect()}
    for k in range(REPS):
        x, y = zip(*((r[1], r[2]) for r in copies(rows, "r", k)), strict=True)
        assert got.pop(k) == pytest.approx((np.corrcoef(x, y)[0, 1], np.corrcoef(ranks(x), ranks(y))[0, 1]))
    assert not got
    flat = resample.correlations(df.withColumn("y", F.lit(4)), "c", REPS, "r", "x", "y").collect()
    assert [(r["pearson"], r["spearman"]) for r in flat] == [(None, None)] * REPS


def test_weights_of_replicates(spark, df, rows, small):
    got = {(r["rep"], r["s"], r["y"]): r["w"] for r in resample.weighted(df, "c", REPS, "w", ["s", "y"]).collect()}
    want = {}
    for k in range(REPS):
        for _, _, y, s in copies(rows, "w", k):
            want[k, s, y] = want.get((k, s, y), 0) + 1
    assert got == want
    assert resample.weighted(df.limit(0), "c", REPS, "w", ["s", "y"]).count() == 0


def test_draws_of_correlations_are_hashed_once(spark, df, small):
    """The result reads stored draws: no step of its plan makes them again."""
    got = resample.correlations(df, "c", REPS, "r", "x", "y")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "").replace("FlatMapCoGroupsInArrow", "")
    assert resample.correlations(df.limit(0), "c", REPS, "r", "x", "y").count() == 0


def test_summaries_of_replicates(spark, df, rows, small):
    """A row for each run, group and block goes on, not one for each replicate and value; what comes of it is that of copies."""
    got = {(r["rep"], r["s"]): r for r in resample.summaries(df, "c", REPS, "w", "s", "y").collect()}
    for k in range(REPS):
        for s in "ab":
            y = np.array([r[2] for r in copies(rows, "w", k) if r[3] == s], float)
            r = got.pop((k, s))
            assert (r["mean"], r["sd"]) == pytest.approx((y.mean(), y.std(ddof=1)))
            assert (r["median"], r["p90"], r["p95"]) == pytest.approx(tuple(np.quantile(y, (0.5, 0.9, 0.95))))
            assert r["over_30"] == pytest.approx((y > 30).mean()) and r["over_45"] == 0
    assert not got
    assert resample.summaries(df.filter("c < 1050"), "c", REPS, "w", "s", "y").count() == 0


def test_long_and_short_slots_share_a_call():
    assert resample._hits("seed", 12, 0, 12_000, 12_000).tolist() == hits("seed", 12, 12_000)
    assert resample._hits("s", 3, 995, 1005, 1005).tolist() == hits("s", 3, 1005)[995:]

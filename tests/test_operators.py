"""Known values and boundary rules of the operators."""

from __future__ import annotations

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import assoc, describe, distance, gates, groups, link, model, order, simulate
from ledgerloom.sources import publish, tables


def one(df, *cols):
    r = df.first()
    return tuple(r[c] for c in cols)


def values(spark, xs, name="x", kind="double"):
    return spark.createDataFrame([(x,) for x in xs], f"{name} {kind}")


def test_describes_a_short_vector(spark):
    got = one(values(spark, [0.0, 1.0, 2.0, 3.0], "value").agg(*describe.block()), "mean", "p50", "sd", "p90", "n", "missing")
    assert got == pytest.approx((1.5, 1.5, math.sqrt(5 / 3), 2.7, 4, 0))


def test_blocks_are_those_of_one_aggregate(spark):
    rows = [("a", i * 7919 % 1009 / 8) for i in range(700)] + [("b", float(i % 3)) for i in range(50)] + [("b", None), ("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "variable string, value double").repartition(5)
    got, want = (df_.orderBy("variable").collect() for df_ in (describe.blocks(df, "variable"), df.groupBy("variable").agg(*describe.block())))
    assert [{k: v if isinstance(v, str) or v is None else pytest.approx(v) for k, v in r.asDict().items()} for r in want] == [r.asDict() for r in got]
    plan = describe.blocks(df, "variable")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan  # which holds all values of a group in one task


def test_constants_and_short_columns_have_no_shape(spark):
    assert one(values(spark, [2.0, 2.0, 2.0, 2.0], "value").agg(*describe.shape()), "skewness", "excess_kurtosis") == (None, None)
    assert one(values(spark, [1.0, 2.0], "value").agg(*describe.shape()), "skewness", "excess_kurtosis") == (None, None)


def test_average_ranks_share_places(spark):
    got = {r["x"]: r["r"] for r in order.average_ranks(values(spark, [1.0, 1.0, 2.0, 5.0, 5.0, 5.0]), {"x": "r"}).collect()}
    assert got == {1.0: 1.5, 2.0: 3.0, 5.0: 5.0}


def test_correlation_of_a_constant_is_unknown(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 4.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(assoc.pearson("x", "y")).first()[0] is None


def test_step_up(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double")
    got = {r["id"]: r["adjusted"] for r in assoc.step_up(df, "p", ["id"]).collect()}
    assert got[4] is None and [got[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.04, 0.04])


@pytest.mark.parametrize("times", [1, 20])
def test_distances_of_shifted_samples(spark, times):
    rows = [(x, True) for x in (0, 1, 2)] + [(x, False) for x in (1, 2, 3) * times]
    df = spark.createDataFrame(rows, "x int, first boolean")
    assert one(distance.distances(df, "x", F.col("first")), "sup_distance", "wasserstein") == pytest.approx((1 / 3, 1.0))


def test_exceedance_is_strict(spark):
    got = one(values(spark, [1, 2, 30, 30, 60, 120], "total", "int").agg(*describe.totals()), "over_30", "median")
    assert got == pytest.approx((2 / 6, 30))


def test_consensus(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (1, None), (2, "A"), (2, "B"), (3, None)], "k int, v string")
    got = {r["k"]: (r["c"], r["s"], r["x"]) for r in df.groupBy("k").agg(link.consensus("v").alias("c"), link.strict("v").alias("s"), link.conflicts(["v"]).alias("x")).collect()}
    assert got == {1: ("A", None, ""), 2: (None, None, "v"), 3: (None, None, "")}


def test_one_to_one_refuses_repeated_keys(spark):
    assert link.one_to_one(values(spark, [1, 2], kind="int"), "x").count() == 2
    with pytest.raises(Exception, match="unique"):
        link.one_to_one(values(spark, [1, 1], kind="int"), "x").collect()


def test_gates_fail_on_null(spark):
    df = gates.with_gates(values(spark, [1, None, 9], kind="int"), {"known": F.col("x").isNotNull(), "small": F.col("x") < 5})
    assert {r["x"]: r["first_failed"] for r in df.collect()} == {1: None, None: "known", 9: "small"}
    assert [(r["rows_before"], r["rows_after"]) for r in gates.funnel(df, ["known", "small"], "x").orderBy("step").collect()] == [(3, 2), (2, 1)]


def test_identifiers_and_dates(spark):
    df = spark.createDataFrame([("123.0",), ("00123",), (" 123.00 ",), (None,), ("  ",)], "x string")
    assert [r[0] for r in df.select(T.key(F.col("x"))).collect()] == ["123", "00123", "123", None, None]
    df = spark.createDataFrame([("31/12/2025",), ("2020-01-01",), ("invalid",), (None,)], "x string")
    assert [str(r[0]) for r in df.select(T.day(F.col("x"))).collect()] == ["2025-12-31", "2020-01-01", "None", "None"]
    df = spark.createDataFrame([("43831",), ("20",), ("x",)], "x string")
    assert [str(r[0]) for r in df.select(T.serial_day(F.col("x"))).collect()] == ["2020-01-01", "None", "None"]


def test_normal_forms(spark):
    df = spark.createDataFrame([("  Ñandú\n é ",), (None,)], "x string")
    assert [tuple(r) for r in df.select(T.upper_norm(F.col("x")), T.compact(F.col("x"))).collect()] == [("NANDU E", "nandue"), ("", "")]
    assert df.select(T.fold(F.col("x"))).first()[0] == "  Nandu\n e "


def test_missing_numbers(spark):
    df = spark.createDataFrame([([1, 2, 5],), ([1],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(T.missing_numbers(F.col("x"))).collect()] == [[3, 4], [], None]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in groups.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((100, 101, 102), 100)}
    assert groups.components(edges.limit(0)).count() == 0


def test_estimates_of_components_do_not_grow_with_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 300)], "a long, b long")
    found = groups.components(edges)
    assert found.filter("component = 1").count() == 300
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 30


def in_turn(sizes, k):
    """Groups one by one, as the definition has it."""
    load, out = [0] * k, {}
    for name, n in sorted(sizes, key=lambda g: (-g[1], g[0])):
        at = min(range(k), key=lambda f: (load[f], f))
        out[name], load[at] = at, load[at] + n
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_folds_are_those_of_one_group_after_another(spark, k):
    import random

    rng = random.Random(k)
    for sizes in ([("a", 5), ("b", 4), ("c", 3), ("d", 3)], [(f"g{i}", rng.choice([1, 1, 1, 2, 3, 50, 1000])) for i in range(300)], [(f"é{i}", 1 + i % 5) for i in range(64)]):
        df = spark.createDataFrame(sizes, "name string, size int").repartition(5)
        assert {r["name"]: r["fold"] for r in groups.balanced_folds(df, k).collect()} == in_turn(sizes, k)
    assert groups.balanced_folds(df.limit(0), k).count() == 0


def test_quantiles_of_distributions():
    assert model.student_quantile(0.975, 29) == pytest.approx(2.0452296, abs=1e-6)
    assert model.student_quantile(0.95, 4) == pytest.approx(2.1318468, abs=1e-6)
    exact = 0
    total = 0.0
    for k in range(51):
        total += math.comb(50, k) * 0.3**k * 0.7 ** (50 - k)
        if total >= 0.975:
            exact = k
            break
    assert model.binomial_quantile(0.975, 50, 0.3) == exact


def test_mixture_inverse(spark):
    us = [0.0, 0.5, 0.51, 0.75, 1.0]
    got = [r[0] for r in values(spark, us, "u").select(simulate.mixture(F.col("u"), 0.5, (8, 2, 2, 4))).collect()]
    assert got == [0.0, 0.0, 2.0, 2.0, 8.0]


def test_copula_moments(spark):
    m = simulate.Phases(0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, (1,), 0.6)
    rows = simulate.trajectories(simulate.draws(spark, 20000).withColumn("zq", F.lit(0.0)), m, "s", "c")
    got = rows.agg(F.corr(F.log("t1"), F.log("t3")), F.avg("t1"), F.max(F.abs(F.col("total") - F.col("t1") - F.col("t3")))).first()
    assert got[0] == pytest.approx(0.6, abs=0.025) and got[1] == pytest.approx(math.exp(0.5), abs=0.06) and got[2] < 1e-9


def test_draws_do_not_depend_on_partitions(spark):
    m = simulate.Phases(0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.5, (1, 2), 0.2)
    rows = simulate.draws(spark, 200).withColumn("zq", F.lit(0.0))
    a = simulate.trajectories(rows, m, "s", "c").orderBy("draw").collect()
    b = simulate.trajectories(rows.repartition(7), m, "s", "c").orderBy("draw").collect()
    assert a == b


def test_constant_scale_fit_is_least_squares(spark):
    rows = spark.createDataFrame([(1.0, float(z), math.exp(1 + 0.5 * z + e)) for z, e in zip(range(-3, 4), (0.1, -0.1, 0, 0.2, -0.2, 0.1, -0.1), strict=True)], "one double, zq double, y double")
    beta, log_sigma = model.fit_constant(rows, ["one", "zq"], "y")
    fit = model.fit_scaled(rows, ["one", "zq"], ["one"], "y")
    assert beta == pytest.approx(fit.beta, abs=1e-6) and log_sigma == pytest.approx(fit.gamma[0], abs=1e-5)


def test_forecast_tails(spark):
    df = model.forecasts(values(spark, [10.0], "y"), F.lit(math.log(10.0)), F.lit(0.5), "y")
    assert one(df, "median", "p90") == pytest.approx((10.0, math.exp(math.log(10) + NormalDist().inv_cdf(0.9) * 0.5)))


def test_publication_is_verified_and_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "out")
    publish.publish({"a": values(spark, [1, 2, 2], kind="int")}, path)
    assert publish.verify(spark, path) == {"a": True}
    with pytest.raises(FileExistsError):
        publish.publish({"a": values(spark, [1], kind="int")}, path)


def test_yearly_families(spark, tmp_path):
    values(spark, [1], "a", "int").write.parquet(str(tmp_path / "y1"))
    spark.createDataFrame([(2, "z")], "a int, b string").write.parquet(str(tmp_path / "y2"))
    got = tables.families(spark, {2020: str(tmp_path / "y1"), 2021: str(tmp_path / "y2")}).orderBy("a").collect()
    assert [(r["a"], r["b"], r["source_year"]) for r in got] == [(1, None, 2020), (2, "z", 2021)]


def test_precision_of_constants(spark):
    rows = simulate.draws(spark, 1000).withColumn("total", F.lit(12.0))
    got = {r["metric"]: r for r in simulate.precision(rows, 1000).collect()}
    assert got["mean"]["estimate"] == 12 and got["sd"]["halfwidth"] == 0 and got["over_30"]["estimate"] == 0 and got["over_30"]["halfwidth"] > 0

"""Family links, delimited publications, comparison of cells, selection of profiles and lineage."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import groups, simulate
from ledgerloom.plans import simulation
from ledgerloom.sources import publish


def test_family_links(spark):
    rows = spark.createDataFrame([(1, "E1"), (2, "E2"), (3, "E3"), (4, "E3")], "code int, entity string")
    families = spark.createDataFrame([(1, 3), (2, 99), (3, 4)], "left int, right int")
    assert sorted(map(tuple, groups.family_links(rows, families, "code", "entity").collect())) == [("E1", "E3"), ("E3", "E3")]


def odd_rows(spark):
    return spark.createDataFrame([(1, "plain", 0.1), (2, 'quo"te, comma', 1 / 3), (3, "line\nbreak", -0.0), (4, "", None), (5, None, float("nan")), (6, " blanks ", 1e300), (7, "back\\slash", 5e-324)], "id int, s string, x double")


def test_publish_csv_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    got = publish.publish_csv({"odd": odd_rows(spark), "none": odd_rows(spark).limit(0)}, path, {"seed": "1"}, {"id": "id > 0"}, rows_a_file=2)
    assert (got["outputs"]["odd"]["rows"], got["outputs"]["none"]["rows"]) == (7, 0)
    assert publish.read_json(spark, f"{path}/manifest.json") == got
    assert publish.publication_faults(spark, path).count() == 0
    assert all(p.suffixes[-1] == ".gz" for p in Path(path, "odd.csv").glob("part-*"))
    with pytest.raises(FileExistsError):
        publish.publish_csv({"odd": odd_rows(spark)}, path, {})
    with pytest.raises(ValueError, match="small: 5"):
        publish.publish_csv({"odd": odd_rows(spark)}, path + "2", {}, {"small": "id < 3"})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_faults_are_found(spark, tmp_path):
    path = tmp_path / "out"
    publish.publish_csv({"odd": odd_rows(spark).repartition(3, "id")}, str(path), {})
    parts = sorted((path / "odd.csv").glob("part-*"))
    assert len(parts) >= 2
    parts[0].write_bytes(parts[0].read_bytes() + b"x")
    (path / "odd.csv" / f".{parts[0].name}.crc").unlink(missing_ok=True)
    parts[1].rename(parts[1].with_name("part-99999-x.csv.gz"))
    found = {r["fault"] for r in publish.publication_faults(spark, str(path)).collect()}
    assert found == {"altered", "missing", "unknown"}


def test_documents_are_replaced(spark, tmp_path):
    path = str(tmp_path / "state.json")
    publish.write_json(spark, path, {"a": 1, "ñ": "é"})
    publish.write_json(spark, path, {"b": [1, 2]})
    assert publish.read_json(spark, path) == {"b": [1, 2]}
    with pytest.raises(ValueError):
        publish.write_json(spark, path, float("nan"))
    assert publish.read_json(spark, path) == {"b": [1, 2]}
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["state.json"]


def test_differences(spark):
    left = odd_rows(spark)
    assert publish.differences(left, left, ["id"]).count() == 0
    right = left.filter("id <> 1").withColumn("x", F.when(F.col("id") == 2, F.col("x") + 1e-9).when(F.col("id") == 6, F.col("x") * (1 + 1e-14)).when(F.col("id") != 5, F.col("x"))).withColumn("s", F.when(F.col("id") != 4, F.col("s")))
    assert {(r["id"], r["column"]) for r in publish.differences(left, right, ["id"]).collect()} == {(1, "*"), (2, "x"), (4, "s"), (5, "x")}
    with pytest.raises(ValueError, match="columns"):
        publish.differences(left, left.drop("s"), ["id"])


def profiles(spark):
    rows = [(i, "low" if i % 3 else "high", "local" if i % 2 else "national", float(i), i / 10, i) for i in range(1, 31)]
    return spark.createDataFrame(rows, "procedure_code long, scenario string, government string, amount double, zq double, q int")


def test_selection_and_lineage(spark):
    p = profiles(spark)
    chosen = simulate.select_profiles(p, "low", "local", (5.0, 25.0))
    assert {r[0] for r in chosen.select("procedure_code").collect()} == {i for i in range(5, 25) if i % 3 and i % 2}
    rows = simulate.with_profiles(simulate.draws(spark, 200), chosen, "s", "c")
    assert tuple(simulate.lineage(rows, p, "procedure_code", ["amount", "q"]).first()) == (200, 0, 0)
    bent = rows.withColumn("q", F.when(F.col("draw") < 7, 0).otherwise(F.col("q"))).withColumn("procedure_code", F.when(F.col("draw") >= 190, -1).otherwise(F.col("procedure_code")))
    assert tuple(simulate.lineage(bent, p, "procedure_code", ["amount", "q"]).first()) == (200, 10, 7)
    with pytest.raises(Exception, match="no profiles for c"):
        simulate.with_profiles(simulate.draws(spark, 5), simulate.select_profiles(p, "medium"), "s", "c").collect()


def test_trajectories_are_published(spark, tmp_path):
    path = str(tmp_path / "trajectories")
    got = simulation.publish_trajectories(spark, "/root/testdata/sf0.001", path, 300, ("M2",), ("low",))
    assert list(got["outputs"]) == ["M2_low"]
    assert {o["rows"] for o in got["outputs"].values()} == {300}
    assert len(simulation.OUTPUT_COLUMNS) == 17
    assert publish.publication_faults(spark, path).count() == 0

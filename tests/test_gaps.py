"""Completeness and missing numbers of conversations with gaps, which the tables don't have."""

from __future__ import annotations

import oracle
import pytest

from ledgerloom.plans import catalog


@pytest.mark.parametrize("name", ["record_completeness", "missing_numbers"])
def test_gaps(spark, tmp_path, name):
    turns = {1: [0, 1, 2], 2: [0, 2, 5], 3: [4], 4: [1, 2]}
    rows = [(c, t, "user", "x") for c, ts in turns.items() for t in ts]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert oracle.difference(got, oracle.connect(str(tmp_path)), catalog.ORACLE_SQL[name]) == ""
    if name == "missing_numbers":
        assert {r["conv_id"]: r["missing"] for r in got.collect()} == {1: "", 2: "2,4,5", 3: "1,2,3,4", 4: "1"}

"""Every plan with SQL of its own gives DuckDB's rows; the others give rows of a stable shape."""

from __future__ import annotations

import oracle
import pytest

from ledgerloom.plans import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    assert oracle.difference(catalog.QUERIES[name](spark, oracle.DATA), con, catalog.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, oracle.DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())

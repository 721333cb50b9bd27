"""Driver contract and Spark-vs-SQL oracle parity for every registered query."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from ridelens.plans import catalog, oracle
from tests.verify import compare, duckdb_connection

from .conftest import SF0001

ORACLE = oracle.oracle_sql()
QUERIES = catalog.all_queries()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["Time", "rank", "endStationName", "Number"]


def test_entry_has_every_catalogued_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF0001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_parity(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLE[name], SF0001, con)
    assert r["ok"], r

"""Every registered query of the engine against DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sealframe.plans import queries
from tests.oracles import check, connect

DIR = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    check(queries.QUERIES[name](spark, DIR), con, SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())

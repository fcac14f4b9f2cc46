"""Every query with SQL against DuckDB on the smallest tables; every other one runs and has columns."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
NAMES = [n for n, q in entry.queries().items() if ".llm." not in q.__module__ and (n in entry.oracle_sql() or not q.__module__.endswith(".models"))]


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df, sql = entry.queries()[name](spark, SF), entry.oracle_sql().get(name)
    if sql:
        assert differences(df, con, sql) == []
    else:
        assert df.columns and df.collect() is not None


def test_entry(spark):
    assert entry.entry(spark).columns == ["card1", "tx_day"]

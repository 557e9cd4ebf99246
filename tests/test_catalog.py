"""Every registered query against its SQL, on tables large enough for the regressions."""

import os

import pytest
from check_oracles import compare, connect
from pyspark.sql import DataFrame

import __spark_entry__ as entry

SF = os.environ.get("WAVESPAN_TEST_SF", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not mounted")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    error, rows, _ = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert error is None
    assert rows >= 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert isinstance(df, DataFrame)
    assert df.columns == ["year", "change_t", "change_24t"] and df.count() == 7

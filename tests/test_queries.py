import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_sql(spark, con, name):
    got_n, want_n, columns, want_columns, got, want = compare(spark, con, SF, name)
    assert got_n > 0
    if want is not None:
        assert columns == want_columns and got == want

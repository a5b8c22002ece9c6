"""Every registered query with checking SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from compare import compare, connect

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = connect(small)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, con, name):
    status, _, _, _, note = compare(spark, con, small, name, QUERIES[name], ORACLE[name])
    assert status == "OK", note


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() == 5 and "f1" in df.columns


def test_duckdb_is_present():
    assert duckdb.__version__

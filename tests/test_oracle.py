"""Every registered query against its DuckDB oracle on the smallest tables."""
import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, con, key, E.queries()[key], E.oracle_sql().get(key), SF)
    assert res["ok"] is not False, res


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "macro_f1" in df.columns

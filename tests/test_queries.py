"""Every registered query beside its SQL twin on the smallest driver tables."""

import os

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
RUNS, SQLS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(RUNS))
def test_query_matches_sql(spark, con, name):
    ok, message, _, _ = compare(spark, con, RUNS[name], SQLS.get(name), SF)
    assert ok, message


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0 and "job_id" in df.columns

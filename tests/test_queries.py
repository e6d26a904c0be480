"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    status, detail, _ = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "ok EMPTY", "rows only"), detail


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "month_key" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

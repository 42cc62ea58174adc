"""Every query against its SQL, also with tables cut into very small chunks."""

import compare
import pytest

import __spark_entry__ as entry_point
from kilnflow.operators.ordered import ROWS_CONF
from kilnflow.plans.catalog import QUERIES
from kilnflow.plans.oracle import SQL

ORDERED = [
    n for n in QUERIES
    if n.split("_")[0] in ("A3", "W1", "W2", "W3", "W4", "W5", "W6", "W7", "W9", "W10", "P10", "J4", "T6")
]


@pytest.fixture(scope="module")
def con(data):
    return compare.duck(data)


def test_same_names():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.columns[0] == "session_id"
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, data, con, name):
    assert compare.compare(con, SQL[name], QUERIES[name](spark, data)) is None


@pytest.mark.parametrize("name", ORDERED)
def test_equals_sql_when_cut_small(spark, data, con, name):
    spark.conf.set(ROWS_CONF, "6")
    try:
        assert compare.compare(con, SQL[name], QUERIES[name](spark, data)) is None
    finally:
        spark.conf.unset(ROWS_CONF)

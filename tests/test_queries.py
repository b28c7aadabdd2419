"""Every query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference
from workload.oracle import SQL
from workload.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, SQL[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_all_have_sql_and_are_registered():
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())

"""Every query of the grid operators against its SQL, and the driver's entry."""

import os

import pytest

import __spark_entry__
from meshframe import queries
from queries_check import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):
    compare(spark, con, FOLDER, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_all_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())

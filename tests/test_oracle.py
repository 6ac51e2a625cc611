"""Every query against its SQL, on the smallest data."""

import os

import oracle
import pytest

import __spark_entry__ as entry

ROOT = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(ROOT)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    if name in SQL:
        assert oracle.compare(spark, connection, ROOT, QUERIES[name], SQL[name]) is None
    else:
        assert QUERIES[name](spark, ROOT).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1

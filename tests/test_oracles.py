"""Every registered query against its SQL, or at least against nothing being returned."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, duck

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, sf, name, QUERIES[name], SQL.get(name)) is None


def test_entry(spark, sf):
    row = entry.entry(spark).first()
    assert row["total_revenue"] > 0 and row["total_orders"] > 0

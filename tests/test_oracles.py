"""Every registered query equals its SQL on the smallest tables."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query_equals_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert oracle.difference(con, sql, df) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 6


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())

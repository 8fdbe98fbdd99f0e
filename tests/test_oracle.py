"""Every query against its SQL on the smallest tables, and the shape of its plan."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", list(entry.base_queries()))
def test_query(spark, database, name):
    """The result equals the SQL's, and no join pairs all rows with all rows."""
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert check.compare(df, database, name) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_has_sql():
    assert set(entry.base_queries()) <= set(entry.oracle_sql())

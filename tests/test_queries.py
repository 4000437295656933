"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

from __future__ import annotations

import pytest

import __spark_entry__ as spark_entry
import workload
from workload.compare import connect, spark_rows, sql_rows

QUERIES, SQL = workload.QUERIES, workload.SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry_runs(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["label", "value", "count"] and df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan, node
    assert spark_rows(df) == sql_rows(con, SQL[name])

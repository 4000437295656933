from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.order_index import OrderIndex
from tallyframe.operators.ordering import numbered
from tallyframe.operators.paging import page, sort_orders, sorted_rows


def table(spark, n=3000):
    # A third of the rows share one sort value and some have none.
    value = F.when(F.col("id") % 3 == 0, F.lit("same")).when(F.col("id") % 20 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id") % 97))
    return spark.range(n).select("id", value.alias("v")).repartition(6)


def keys(df):
    return [r.id for r in df.collect()]


def scanned(df):
    """Rows that the scans of a plan gave out while it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("descending", [False, True])
def test_pages_equal_the_sorted_table(spark, descending):
    df = table(spark)
    orders = sort_orders(df, ["id"], "v", descending)
    index = OrderIndex.build(df, orders, range_rows=700)
    assert index.total == 3000 and len(index.ranges) > 2
    whole = keys(sorted_rows(df, orders))
    for start in (0, 690, 1500, 2990):
        assert keys(index.rows_between(start, 30)) == whole[start : start + 30]
    found, plain = index.page(17, 40), page(df, ["id"], "v", descending, 17, 40)
    assert (found.total, found.pages, found.page, keys(found.rows)) == (plain.total, plain.pages, plain.page, keys(plain.rows))
    again = OrderIndex.load(spark, index.path, orders)
    assert again.ranges == index.ranges


@pytest.mark.parametrize("descending", [False, True])
def test_pages_follow_each_other(spark, descending):
    df = table(spark, 400)
    orders = sort_orders(df, ["id"], "v", descending)
    index = OrderIndex.build(df, orders, range_rows=60)
    whole = sorted_rows(df, orders).collect()
    for at in (0, 58, 133, 380, 399):
        behind = index.page_after((whole[at].v, whole[at].id), 35)
        assert keys(behind) == [r.id for r in whole[at + 1 : at + 36]]


def test_a_page_reads_little(spark):
    df = spark.range(200_000).select("id", (F.col("id") * 7919 % 200_003).alias("v")).repartition(6)
    index = OrderIndex.build(df, sort_orders(df, ["id"], "v"), range_rows=50_000)
    rows = index.rows_between(123_456, 25)
    assert [r.v for r in rows.collect()] == sorted(i * 7919 % 200_003 for i in range(200_000))[123_456:123_481]
    assert 25 <= scanned(rows) < 4_000


def test_empty_table(spark):
    df = table(spark, 0)
    index = OrderIndex.build(df, sort_orders(df, ["id"], "v"))
    found = index.page(3)
    assert (found.total, found.pages, found.page, keys(found.rows), keys(index.page_after(("v", 1)))) == (0, 1, 1, [], [])


def test_numbered_rows(spark):
    df = table(spark, 500)
    placed = {r.id: r.position for r in numbered(df, F.asc_nulls_last("v"), "id").collect()}
    whole = keys(sorted_rows(df, sort_orders(df, ["id"], "v")))
    assert [k for k, _ in sorted(placed.items(), key=lambda kv: kv[1])] == whole

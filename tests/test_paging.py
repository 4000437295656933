from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.paging import page, page_after, rows_between, sort_orders, sorted_rows


def table(spark, n=3000):
    # A third of the rows share one sort value and some have none.
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).when(F.col("id") % 20 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id") % 97)).alias("v"),
    ).repartition(6)


def keys(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("descending", [False, True])
def test_nulls_are_last_both_ways(spark, descending):
    df = table(spark, 60)
    made = [r.v for r in sorted_rows(df, sort_orders(df, ["id"], "v", descending)).collect()]
    filled = [v for v in made if v is not None]
    assert made[: len(filled)] == sorted(filled, reverse=descending) and None in made


@pytest.mark.parametrize("descending", [False, True])
def test_pages_join_to_the_sorted_table(spark, descending):
    df = table(spark, 95)
    orders = sort_orders(df, ["id"], "v", descending)
    whole = keys(sorted_rows(df, orders))
    first = page(df, ["id"], "v", descending, 1, 40)
    assert (first.total, first.pages, first.page_size) == (95, 3, 40)
    joined = [k for n in (1, 2, 3) for k in keys(page(df, ["id"], "v", descending, n, 40).rows)]
    assert joined == whole


@pytest.mark.parametrize("size, number, expected", [(1, 1, (5, 1)), (500, 9, (100, 1)), (25, 0, (25, 1)), (25, 99, (25, 3))])
def test_clamping(spark, size, number, expected):
    found = page(table(spark, 60), ["id"], number=number, size=size)
    assert (found.page_size, found.page) == expected


def test_empty_table_and_unknown_sort(spark):
    found = page(table(spark, 0), ["id"], "nope")
    assert (found.total, found.pages, found.page, keys(found.rows)) == (0, 1, 1, [])
    assert keys(page(table(spark, 30), ["id"], "nope", True, 1, 5).rows) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("start", [0, 777, 1500, 2950, 2999])
def test_deep_rows_equal_offset(spark, start, descending):
    df = table(spark)
    orders = sort_orders(df, ["id"], "v", descending)
    deep = rows_between(df, orders, start, 30, 3000, direct_start=100)
    assert keys(deep) == keys(sorted_rows(df, orders).offset(start).limit(30))


@pytest.mark.parametrize("descending", [False, True])
def test_keyset_pages_walk_the_table(spark, descending):
    df = table(spark, 120)
    orders = sort_orders(df, ["id"], "v", descending)
    last, walked = None, []
    while True:
        rows = page_after(df, orders, last, 50).collect()
        if not rows:
            break
        walked += [r.id for r in rows]
        last = (rows[-1].v, rows[-1].id)
    assert walked == keys(sorted_rows(df, orders))


def test_page_is_a_bounded_top_k(spark):
    plan = page(table(spark, 300), ["id"], "v", number=3).rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan

"""Lookup joins: the broadcast and the shuffled way agree, also on hot keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.attach import attach, measure, require_unique


def big(spark):
    # A third of all rows share one key; some keys have no match; one key is null.
    return spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 90).cast("int").alias("k"),
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_shuffled_join_equals_broadcast(spark, how):
    lookup = spark.range(80).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    small = measure(lookup, ["k"])
    large = measure(lookup, ["k"], max_bytes=10_000)
    assert small.small and not large.small
    one = sorted(map(tuple, attach(big(spark), small, how).select("id", "k", "v").collect()))
    two = sorted(map(tuple, attach(big(spark), large, how).select("id", "k", "v").collect()))
    assert one == two
    assert (len(one) == 3000) == (how == "left")


def test_small_lookup_is_broadcast(spark):
    lookup = measure(spark.range(5).withColumnRenamed("id", "k"), ["k"])
    plan = attach(big(spark).withColumn("k", F.col("k").cast("bigint")), lookup)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_long_rows_are_not_collected(spark):
    lookup = spark.createDataFrame([(1, "a"), (2, "b" * 5000)], "k int, v string")
    large = measure(lookup, ["k"])
    assert not large.small and measure(lookup, ["k"], row_bytes=10_000).small
    assert {len(r.v) for r in attach(spark.range(1, 3).select(F.col("id").cast("int").alias("k")), large).collect()} == {1, 5000}


def test_lookup_without_keys(spark):
    one = measure(spark.createDataFrame([(3, "x")], "a int, b string"), [])
    none = measure(spark.createDataFrame([], "a int, b string"), [])
    rows = spark.range(2)
    assert [tuple(r) for r in attach(rows, one).orderBy("id").collect()] == [(0, 3, "x"), (1, 3, "x")]
    assert [tuple(r) for r in attach(rows, none).orderBy("id").collect()] == [(0, None, None), (1, None, None)]
    assert attach(rows, none, "inner").count() == 0


def test_repeated_keys_are_refused(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="repeated lookup keys"):
        require_unique(df, ["k"])

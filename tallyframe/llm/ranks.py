"""Exact running sums over large groups without putting a group into one task.

Rows are dealt into small bins by a prefix of an ordering hash; bins are summed before any shuffle of
rows, offsets of bins come from two levels of running sums, and only inside a bin is there a window
over rows. A hot group has many bins, so it has many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bin holds on average.
ROWS_PER_BIN = 500


def bins_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BIN))


def hash_bin(hex_hash: Column, bins: int) -> Column:
    """A bin from 0 to bins - 1 that keeps the order of a hexadecimal hash, by its first 12 digits."""
    head = F.conv(F.substring(hex_hash, 1, 12), 16, 10).cast("long")
    return F.least(F.floor(head.cast("double") / F.lit(float(1 << 48)) * bins), F.lit(bins - 1)).cast("long")


def with_running_sum(
    rows: DataFrame, group: list[str], bin_column: str, order: list[str], value: str, out: str
) -> DataFrame:
    """``rows`` with the sum of ``value`` over earlier rows of the group, by (bin, order).

    ``group`` may be empty. Bins must not decrease with the order. ``rows`` is read twice, so it
    should be a stored table. Rows equal in all of ``order`` are in any order among themselves.
    """
    sums = rows.groupBy(*group, bin_column).agg(F.sum(value).alias("_sum"))
    # About the square root of a group's bins share a block; only block totals meet in one window.
    block = F.floor(F.sqrt(F.col(bin_column).cast("double"))).cast("long")
    blocks = sums.groupBy(*group, block.alias("_block")).agg(F.sum("_sum").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_block",
                           F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before_block"))
    sums = sums.withColumn("_block", block)
    same = F.col("_b._block") == F.col("_s._block")
    for i, g in enumerate(group):
        same &= F.col(f"_b._g{i}").eqNullSafe(F.col(f"_s.`{g}`"))
    joined = sums.alias("_s").join(blocks.alias("_b"), same)
    inside = Window.partitionBy(*[F.col(f"_s.`{g}`") for g in group], F.col("_s._block")).orderBy(
        F.col(f"_s.{bin_column}")
    ).rowsBetween(Window.unboundedPreceding, -1)
    offsets = joined.select(
        *[F.col(f"_s.`{g}`").alias(f"_g{i}") for i, g in enumerate(group)],
        F.col(f"_s.{bin_column}").alias("_bin"),
        (F.col("_before_block") + F.coalesce(F.sum("_sum").over(inside), F.lit(0))).alias("_offset"),
    )
    same = F.col("_o._bin") == F.col(f"_r.{bin_column}")
    for i, g in enumerate(group):
        same &= F.col(f"_o._g{i}").eqNullSafe(F.col(f"_r.`{g}`"))
    local = Window.partitionBy(*group, bin_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.alias("_r")
        .join(offsets.alias("_o"), same)
        .select("_r.*", "_o._offset")
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(local), F.lit(0)))
        .drop("_offset")
    )

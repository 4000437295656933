"""Positions of rows in an order, found by one range sort and never by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.session import materialize

# Bits of a generated row number that count rows inside a partition.
_ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``rows`` with their place from 0 in the given order, stored in that order.

    ``rows`` is read twice, so it should be a stored table. A row's place is that in its sorted
    partition, written down while sorted, plus the rows of earlier partitions. The window sees
    one row per partition. The order must be total for the places to be repeatable.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = placed.join(F.broadcast(before), part == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + inside).drop("_at", "_part", "_before")

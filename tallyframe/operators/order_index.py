"""A stored order of a table, so that any page of it is one range read.

Building sorts the table once into ranges and writes each range as a folder, its rows numbered in
order. A small table of splitters says how many rows each range has and with which sort values it
begins. A page then names its ranges and row numbers: other folders are not opened, and inside a
range the reader skips all column pages with other row numbers. Nothing is sampled or counted.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyframe.functions.cast import ref, without_nan
from tallyframe.operators.paging import DEFAULT_SIZE, Order, Page, _before, _clamp, sorted_rows
from tallyframe.session import scratch_path

PART, ROW = "_order_part", "_order_row"
# Rows of a column page, the least that a range read looks at.
PAGE_ROWS = 500
# Rows of a range; the splitters, one per range, are all that a reader keeps.
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class OrderIndex:
    """A table stored in the order of ``orders``."""

    spark: SparkSession
    path: str
    orders: tuple[Order, ...]
    #: Per range its number, rows and first sort values, in order.
    ranges: tuple[tuple, ...]

    @classmethod
    def build(
        cls, df: DataFrame, orders: Sequence[Order], path: str | None = None, total: int | None = None, range_rows: int = RANGE_ROWS
    ) -> OrderIndex:
        """Sort and write ``df`` once. The orders must end in unique keys. Without ``path``, the shared folder is used."""
        spark = df.sparkSession
        path = path or scratch_path(spark, "order")
        df = without_nan(df)
        rows = df.count() if total is None else total
        by = [o.column() for o in orders]
        dealt = df.repartitionByRange(max(1, -(-rows // range_rows)), *by).sortWithinPartitions(*by)
        numbered = dealt.withColumns({PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id()})
        inside = F.col(ROW).bitwiseAND(F.lit((1 << 33) - 1))
        # Already so sorted; saying it keeps the writer from sorting by the folder alone.
        numbered.withColumn(ROW, inside).sortWithinPartitions(PART, ROW).write.option(
            "parquet.page.row.count.limit", str(PAGE_ROWS)
        ).partitionBy(PART).parquet(f"{path}/rows")
        df.limit(0).write.parquet(f"{path}/columns")  # an empty table has no range to name them
        stored = _stored(spark, path)
        first = F.min_by(F.struct(*[ref(o.name).alias(f"v{i}") for i, o in enumerate(orders)]), ROW).alias("first")
        stored.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), first).coalesce(1).write.parquet(f"{path}/splitters")
        return cls.load(spark, path, orders)

    @classmethod
    def load(cls, spark: SparkSession, path: str, orders: Sequence[Order]) -> OrderIndex:
        """An index written before; reads its splitters, one row per range."""
        rows = spark.read.parquet(f"{path}/splitters").orderBy(PART).collect()
        return cls(spark, path, tuple(orders), tuple((r[PART], r["rows"], tuple(r["first"])) for r in rows))

    @property
    def total(self) -> int:
        return sum(n for _, n, _ in self.ranges)

    def _read(self, wanted: Sequence[Column]) -> DataFrame:
        found = _stored(self.spark, self.path).filter(reduce(Column.__or__, wanted, F.lit(False)))
        return sorted_rows(found, [Order(PART), Order(ROW)])

    def rows_between(self, start: int, size: int) -> DataFrame:
        """``size`` rows from position ``start``, in order: one read of at most a few ranges."""
        ends = list(accumulate(n for _, n, _ in self.ranges))
        wanted = []
        for (part, n, _), end in zip(self.ranges, ends):
            low, high = max(start - (end - n), 0), min(start + size - (end - n), n)
            if low < high:
                wanted.append((F.col(PART) == part) & (F.col(ROW) >= low) & (F.col(ROW) < high))
        return self._read(wanted).drop(PART, ROW)

    def page(self, number: int = 1, size: int = DEFAULT_SIZE) -> Page:
        """One page, clamped as ``paging.page`` does."""
        size = _clamp(size)
        total = self.total
        pages = max(1, -(-total // size))
        number = min(max(number, 1), pages)
        return Page(self.rows_between((number - 1) * size, size), total, number, size, pages)

    def page_after(self, last: Sequence[Any], size: int = DEFAULT_SIZE) -> DataFrame:
        """The page behind a known last row: its range is found by the splitters, and read with later ones as needed."""
        size = _clamp(size)
        keys = [_Place(self.orders, first) for _, _, first in self.ranges]
        at = max(bisect_right(keys, _Place(self.orders, tuple(last))) - 1, 0)
        # Ranges behind the first one are only read for their first rows.
        wanted = [F.col(PART) == self.ranges[at][0]] if self.ranges else []
        more, left = [], size
        for part, n, _ in self.ranges[at + 1 :]:
            if left <= 0:
                break
            more.append((F.col(PART) == part) & (F.col(ROW) < left))
            left -= n
        behind = self._read([*wanted, *more]).filter(~_before(self.orders, last, inclusive=True))
        return behind.limit(size).drop(PART, ROW)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add(ROW, T.LongType()).add(PART, T.IntegerType())).parquet(f"{path}/rows")


class _Place:
    """Sort values as a key that compares like the table's order: missing ones last, some orders descending."""

    def __init__(self, orders: Sequence[Order], values: Sequence[Any]):
        self.orders, self.values = orders, values

    def __lt__(self, other: _Place) -> bool:
        for order, a, b in zip(self.orders, self.values, other.values):
            if a is None or b is None:
                if (a is None) != (b is None):
                    return b is None
            elif a != b:
                return (a > b) if order.descending else (a < b)
        return False

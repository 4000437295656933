"""Sorted pages of a table, by number or after a given row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.cast import ref, without_nan

MIN_SIZE, MAX_SIZE, DEFAULT_SIZE = 5, 100, 25
# Deepest start that a plain bounded top-k serves.
DIRECT_START = 10_000
SPLITTERS = 48


@dataclass(frozen=True)
class Order:
    """One sort column; nulls come last in both directions."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        c = ref(self.name)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()

    def precedes(self, bound: Any) -> tuple[Column, Column]:
        """Whether the row sorts before the bound on this column, and whether it ties."""
        c = ref(self.name)
        if bound is None:
            return c.isNotNull(), c.isNull()
        value = F.lit(bound)
        before = c > value if self.descending else c < value
        return F.coalesce(before, F.lit(False)), c.eqNullSafe(value)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    page: int
    page_size: int
    pages: int


def sort_orders(df: DataFrame, tie_keys: Sequence[str], sort_by: str | None = None, descending: bool = False) -> list[Order]:
    """The asked column (ignored when unknown), then the unique tie keys ascending."""
    asked = [Order(sort_by, descending)] if sort_by in df.columns else []
    return asked + [Order(k) for k in tie_keys if k != sort_by]


def sorted_rows(df: DataFrame, orders: Sequence[Order]) -> DataFrame:
    return df.orderBy(*[o.column() for o in orders])


def _before(orders: Sequence[Order], bounds: Sequence[Any], inclusive: bool = False) -> Column:
    """Lexicographic "row sorts before the bound"; inclusive also takes the bound's own row."""
    result = F.lit(inclusive)
    for order, bound in reversed(list(zip(orders, bounds, strict=True))):
        less, tie = order.precedes(bound)
        result = less | (tie & result)
    return result


def page_after(df: DataFrame, orders: Sequence[Order], last: Sequence[Any] | None, size: int = DEFAULT_SIZE) -> DataFrame:
    """The page that follows a known last row: cost does not grow with the depth.

    ``last`` holds the sort values of that row; ``None`` asks for the first page.
    """
    rest = df if last is None else df.filter(~_before(orders, last, inclusive=True))
    return sorted_rows(rest, orders).limit(_clamp(size))


def _clamp(size: int) -> int:
    return max(MIN_SIZE, min(size, MAX_SIZE))


def rows_between(df: DataFrame, orders: Sequence[Order], start: int, size: int, total: int, direct_start: int = DIRECT_START) -> DataFrame:
    """``size`` rows from position ``start`` of the sorted table.

    A bounded top-k keeps ``start + size`` rows per task and on the driver, so a deep start
    is first narrowed: a few sampled rows cut the order into intervals, one counting pass
    tells how many rows lie in each, and all intervals before the start are dropped. The
    sample only decides how fast that narrows; positions come from the counts.
    """
    left, width, low, high = start, total, None, None
    while left > direct_start:
        scope = df
        if low is not None:
            scope = scope.filter(~_before(orders, low))
        if high is not None:
            scope = scope.filter(_before(orders, high))
        names = [o.name for o in orders]
        fraction = min(1.0, 20.0 * SPLITTERS / max(width, 1))
        sample = sorted_rows(scope.select(*names).sample(fraction, seed=width % 2**31), orders)
        picked = [tuple(r) for r in sample.limit(200 * SPLITTERS).collect()]
        step = max(1, len(picked) // SPLITTERS)
        bounds = picked[step::step][: SPLITTERS + 1]
        if not bounds:
            break
        below = [F.count(F.when(_before(orders, b), 1)).alias(f"n{i}") for i, b in enumerate(bounds)]
        counts = list(scope.agg(*below).first())
        passed = [i for i, n in enumerate(counts) if n <= left]
        ahead = [i for i, n in enumerate(counts) if n > left]
        if not passed or counts[passed[-1]] == 0:
            if not ahead:
                break
            high, width = bounds[ahead[0]], counts[ahead[0]]
            continue
        low = bounds[passed[-1]]
        left -= counts[passed[-1]]
        width -= counts[passed[-1]]
        if ahead:
            high, width = bounds[ahead[0]], counts[ahead[0]] - counts[passed[-1]]
    rest = df if low is None else df.filter(~_before(orders, low))
    return sorted_rows(rest, orders).offset(left).limit(size)


def page(
    df: DataFrame,
    tie_keys: Sequence[str],
    sort_by: str | None = None,
    descending: bool = False,
    number: int = 1,
    size: int = DEFAULT_SIZE,
    direct_start: int = DIRECT_START,
) -> Page:
    """One page: size clamped to 5..100, number clamped to the pages there are."""
    size = _clamp(size)
    df = without_nan(df)
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(number, 1), pages)
    orders = sort_orders(df, tie_keys, sort_by, descending)
    rows = rows_between(df, orders, (number - 1) * size, size, total, direct_start)
    return Page(rows, total, number, size, pages)

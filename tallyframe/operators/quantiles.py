"""Exact quantiles of grouped values, also where one group is too large for one task.

The built-in ``percentile`` is exact but keeps a map of all distinct values of a group in
one task. It is used while every group is known to be small. Beyond that the wanted order
statistics are located in passes that keep nothing but counts:

1. approximate quantiles just below and above each wanted rank, taken from a fixed number of
   sampled values per group, cut the group into a few intervals;
2. all rows of each interval are counted, which tells the interval a wanted rank lies in;
3. only the rows of those intervals (about one in four hundred) are counted by value, and
   the running count names the value at the rank. Equal values become one counted row, so
   a hot value is no load.

The cuts decide how little is left for step 3, never the result: every row is counted, and a
rank that lies outside its expected interval is found in another one. If an interval still
holds too many different values, the counted values are written out and cut again, now
evenly by different values, so that every round leaves a sixtieth.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.cast import present, unpivoted
from tallyframe.operators.attach import Lookup, attach, measure
from tallyframe.session import materialize

# Up to this many values per group the built-in aggregate is used.
DIRECT_VALUES = 1_000_000
SKETCH_ACCURACY = 10_000
# Values per group that the cuts are taken from: a sketch of everything would make the one
# task that merges a group read a sketch from every task of the scan.
CUT_VALUES = 2_000_000
GRID = [i / 64 for i in range(1, 64)]
MAX_ROUNDS = 12


def long_values(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(by, column, value)`` for every non-missing number; a narrow map, no shuffle."""
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            present(name, df.schema[name].dataType).cast("double").alias("value"),
        )
        for name in columns
    ]
    listed = df.select(*by, unpivoted(cells, "column: string, value: double"))
    return listed.filter(F.col("value").isNotNull())


def quantiles(
    values: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    direct_values: int = DIRECT_VALUES,
    largest: int | None = None,
) -> DataFrame:
    """``keys``, ``valid_count`` and ``q0, q1, ...``: linearly interpolated quantiles.

    ``values`` holds the keys and a non-null double ``value``. ``largest`` is an upper bound of
    the group sizes, if the caller has counted already.
    """
    keys = list(keys)
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("valid_count"))
    if largest is None:
        largest = sizes.agg(F.max("valid_count")).first()[0] or 0
    if largest > direct_values:
        return _interpolated(values, keys, sizes, probabilities, direct_values)
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    exact = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_count"), F.percentile("value", probs).alias("_q")
    )
    return exact.select(
        *keys, "valid_count", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probabilities))]
    )


def _interpolated(values, keys, sizes, probabilities, direct_values) -> DataFrame:
    sizes = measure(sizes, keys).table
    last = F.col("valid_count") - 1
    ends = [
        F.struct(rank(F.lit(float(p)) * last).alias("_rank"))
        for p in probabilities
        for rank in (F.floor, F.ceil)
    ]
    ranks = sizes.select(*keys, F.inline(F.array(*ends))).distinct()
    # The first cuts keep the error of the sketch and of the sample on either side.
    margin = 2.0 / SKETCH_ACCURACY + 1.75 / sqrt(CUT_VALUES)
    around = {q for p in probabilities for q in (p - margin, p + margin) if 0.0 < q < 1.0}
    counted = sizes.withColumnRenamed("valid_count", "_size")
    found = order_statistics(values, keys, counted, ranks, sorted(around) or GRID, direct_values)

    by_rank = found.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")
    )

    def mixed(p: float) -> Column:
        position = F.lit(float(p)) * last
        low, high = F.col("_at")[F.floor(position)], F.col("_at")[F.ceil(position)]
        share = position - F.floor(position)
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    return sizes.join(by_rank, keys).select(
        *keys, "valid_count", *[mixed(p).alias(f"q{i}") for i, p in enumerate(probabilities)]
    )


@dataclass(frozen=True)
class _Cut:
    rows: DataFrame  # keys, value, _n, _interval
    targets: DataFrame  # keys, _interval, _rank, _before
    hit: Lookup  # the intervals that hold a wanted rank


def _interval_of(value: Column, cuts: Column, n: int) -> Column:
    """How many of the cuts lie below the value."""
    below = F.lit(0)
    for i in range(n):
        below = below + F.coalesce(F.get(cuts, F.lit(i)) < value, F.lit(False)).cast("int")
    return below


def _cut(
    rows: DataFrame, keys: list[str], sizes: DataFrame, ranks: DataFrame, cut_points: Sequence[float]
) -> _Cut:
    probs = F.array(*[F.lit(float(p)) for p in cut_points])
    sized = attach(rows, measure(sizes.select(*keys, "_size"), keys))
    picked = sized.filter(F.rand(17) < F.lit(float(CUT_VALUES)) / F.col("_size"))
    cuts = picked.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("value", probs, SKETCH_ACCURACY)).alias("_cuts")
    )
    # A group without cuts stays whole in its first interval.
    interval = _interval_of(F.col("value"), F.col("_cuts"), len(cut_points))
    placed = attach(rows, measure(cuts, keys)).select(*keys, "value", "_n", interval.alias("_interval"))

    counted = placed.groupBy(*keys, "_interval").agg(F.sum("_n").alias("_n"))
    spans = _running(counted, keys, "_interval")
    offset = F.col("_rank") - F.col("_before")
    hits = spans.join(ranks, keys).filter((offset >= F.col("_start")) & (offset < F.col("_end")))
    targets = measure(
        hits.select(*keys, "_interval", "_rank", (F.col("_before") + F.col("_start")).alias("_before")),
        [*keys, "_interval"],
    ).table
    hit = measure(targets.select(*keys, "_interval").distinct(), [*keys, "_interval"])
    return _Cut(placed, targets, hit)


def _running(counted: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Half-open rank spans of counted rows within their group."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    ends = counted.withColumn("_end", F.sum("_n").over(ordered))
    return ends.withColumn("_start", F.col("_end") - F.col("_n"))


def order_statistics(
    rows: DataFrame,
    keys: Sequence[str],
    sizes: DataFrame,
    ranks: DataFrame,
    cut_points: Sequence[float],
    direct_values: int = DIRECT_VALUES,
) -> DataFrame:
    """The value at each wanted zero-based ``_rank`` of its group, as ``_value``.

    ``sizes`` holds the rows of each group as ``_size``.
    """
    group, keys = list(keys), list(keys)
    rows = rows.select(*keys, "value", F.lit(1).cast("bigint").alias("_n"))
    ranks = ranks.withColumn("_before", F.lit(0).cast("bigint"))
    for round_ in range(MAX_ROUNDS):
        cut = _cut(rows, keys, sizes, ranks, cut_points)
        keys = [*keys, "_interval"]
        inside = attach(cut.rows, cut.hit, "inner")
        by_value = inside.groupBy(*keys, "value").agg(F.sum("_n").alias("_n"))
        sizes = measure(by_value.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")), keys).table
        if (sizes.agg(F.max("_size")).first()[0] or 0) <= direct_values:
            break
        # Too many left: each hit interval becomes a group of its own and is cut finer.
        deeper = f"_interval{round_}"
        rows = materialize(by_value, "interval").withColumnRenamed("_interval", deeper)
        sizes = sizes.withColumnRenamed("_interval", deeper)
        ranks = cut.targets.withColumnRenamed("_interval", deeper)
        keys, cut_points = [*keys[:-1], deeper], GRID
    else:
        raise RuntimeError("quantile intervals did not shrink")

    offset = F.col("_rank") - F.col("_before")
    at = _running(by_value, keys, "value").join(cut.targets, keys)
    hits = at.filter((offset >= F.col("_start")) & (offset < F.col("_end")))
    return hits.select(*group, "_rank", F.col("value").alias("_value"))

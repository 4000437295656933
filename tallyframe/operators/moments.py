"""One pass per source whose numbers many reports read.

``moments`` gives one line per source and column: rows, present cells, mean and spread of numbers,
co-moments with the score, and a quantile sketch. Lines of parts of a source merge into the lines
of the whole, so they can be stored per delivery. ``Fitted`` holds the merged lines (sources x
columns) and turns them into the missing report, profile, correlations and imputation statistics
without reading the rows again.

``exact_ranks`` reads the rows once more for exact order statistics: the sketch says between which
values each wanted rank lies, one pass counts what lies below, between and inside, and only values
inside are told apart. The counts decide; where a rank lies outside its interval, or the sketch was
too coarse, the interval is widened and counted again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import ceil, floor, isfinite

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe import presets
from tallyframe.functions.cast import is_float, is_numeric, unpivoted
from tallyframe.operators.profile import (
    CORRELATION_SCHEMA,
    SOURCE,
    Tables,
    cell,
    data_columns,
    find_target,
    source_keys,
    stacked,
)
from tallyframe.session import materialize

# Size of a sketch; its rank error, for one quantile at 99 percent, is 2.296 / size ** 0.9723.
SKETCH_SIZE = 4_000
LINE = (
    "column: string, dtype: string, numeric: boolean, place: int, rows: bigint, present: bigint, mean: double, "
    "squares: double, low: double, high: double, target: string, pairs: bigint, pair_mean: double, "
    "pair_squares: double, target_mean: double, target_squares: double, products: double, "
    "pair_low: double, pair_high: double, target_low: double, target_high: double, sketch: binary"
)


def rank_error(size: int = SKETCH_SIZE) -> float:
    """The share of all values by which a rank from a sketch is off, in 99 of 100 cases."""
    return 2.296 / size**0.9723


def moments(
    tables: Tables,
    by: Sequence[str] = (),
    aliases: Sequence[str] = presets.TARGET_ALIASES,
    sketch_size: int = SKETCH_SIZE,
) -> DataFrame:
    """Lines of all columns: one scan and one wide aggregate per source, unpivoted after."""
    return stacked(tables, by, lambda df, keys: _moments(df, keys, aliases, sketch_size))


def _moments(df: DataFrame, by: list[str], aliases: Sequence[str], sketch_size: int) -> DataFrame:
    names = data_columns(df, by)
    numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
    target = find_target(names, aliases)
    paired = target if target in numeric else None
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(names):
        aggregates.append(F.count(cell(df, name)).alias(f"_n{i}"))
        if name not in numeric:
            continue
        x = cell(df, name).cast("double")
        aggregates += [
            F.avg(x).alias(f"_mean{i}"),
            F.var_pop(x).alias(f"_var{i}"),
            F.min(x).alias(f"_low{i}"),
            F.max(x).alias(f"_high{i}"),
            F.kll_sketch_agg_double(x, sketch_size).alias(f"_sketch{i}"),
        ]
        if paired is not None and name != paired:
            y = cell(df, paired).cast("double")
            both = x.isNotNull() & y.isNotNull()
            xx, yy = F.when(both, x), F.when(both, y)
            aggregates += [
                F.count(xx).alias(f"_pairs{i}"),
                F.avg(xx).alias(f"_xm{i}"),
                F.var_pop(xx).alias(f"_xv{i}"),
                F.avg(yy).alias(f"_ym{i}"),
                F.var_pop(yy).alias(f"_yv{i}"),
                F.covar_pop(xx, yy).alias(f"_xy{i}"),
                # Whether one side is constant is told by its ends: a variance keeps a trace of rounding.
                F.min(xx).alias(f"_xl{i}"),
                F.max(xx).alias(f"_xh{i}"),
                F.min(yy).alias(f"_yl{i}"),
                F.max(yy).alias(f"_yh{i}"),
            ]
    counted = df.groupBy(*by).agg(*aggregates)
    none = F.lit(None).cast("double")

    def line(i: int, name: str):
        number, pair = name in numeric, paired is not None and name in numeric and name != paired
        n, pairs = F.col(f"_n{i}"), F.col(f"_pairs{i}") if pair else F.lit(None).cast("bigint")
        return F.struct(
            F.lit(name).alias("column"),
            F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
            F.lit(number).alias("numeric"),
            F.lit(i).alias("place"),
            F.col("_rows").alias("rows"),
            n.alias("present"),
            (F.col(f"_mean{i}") if number else none).alias("mean"),
            (F.col(f"_var{i}") * n if number else none).alias("squares"),
            (F.col(f"_low{i}") if number else none).alias("low"),
            (F.col(f"_high{i}") if number else none).alias("high"),
            F.lit(target).cast("string").alias("target"),
            pairs.alias("pairs"),
            (F.col(f"_xm{i}") if pair else none).alias("pair_mean"),
            (F.col(f"_xv{i}") * pairs if pair else none).alias("pair_squares"),
            (F.col(f"_ym{i}") if pair else none).alias("target_mean"),
            (F.col(f"_yv{i}") * pairs if pair else none).alias("target_squares"),
            (F.col(f"_xy{i}") * pairs if pair else none).alias("products"),
            (F.col(f"_xl{i}") if pair else none).alias("pair_low"),
            (F.col(f"_xh{i}") if pair else none).alias("pair_high"),
            (F.col(f"_yl{i}") if pair else none).alias("target_low"),
            (F.col(f"_yh{i}") if pair else none).alias("target_high"),
            (F.col(f"_sketch{i}") if number else F.lit(None).cast("binary")).alias("sketch"),
        )

    return counted.select(*by, unpivoted([line(i, name) for i, name in enumerate(names)], LINE))


def merge_moments(lines: DataFrame, by: Sequence[str] = (SOURCE,)) -> DataFrame:
    """Lines of parts of a source, such as one per delivery, as the lines of the whole.

    Squares and products of a part are around its own mean; around the common mean they grow by the
    part's rows times the (products of the) distances of the means.
    """
    of = Window.partitionBy(*by, "column")

    def common(mean: str, n: str):
        weighted = F.sum(F.col(mean) * F.col(n)).over(of)
        return F.try_divide(weighted, F.sum(F.when(F.col(mean).isNotNull(), F.col(n))).over(of))

    known = lines.withColumns(
        {
            "_mean": common("mean", "present"),
            "_x": common("pair_mean", "pairs"),
            "_y": common("target_mean", "pairs"),
        }
    )
    dx, dy = F.col("pair_mean") - F.col("_x"), F.col("target_mean") - F.col("_y")
    around = F.col("mean") - F.col("_mean")
    added = {
        "squares": F.col("squares") + F.col("present") * around * around,
        "pair_squares": F.col("pair_squares") + F.col("pairs") * dx * dx,
        "target_squares": F.col("target_squares") + F.col("pairs") * dy * dy,
        "products": F.col("products") + F.col("pairs") * dx * dy,
    }
    sums = [F.sum(c).alias(c) for c in ("rows", "present", "pairs", *added)]
    merged = known.withColumns(added).groupBy(*by, "column").agg(
        *[F.first(c).alias(c) for c in ("dtype", "numeric", "target")],
        F.min("place").alias("place"),
        *sums,
        F.first("_mean", ignorenulls=True).alias("mean"),
        F.first("_x", ignorenulls=True).alias("pair_mean"),
        F.first("_y", ignorenulls=True).alias("target_mean"),
        *[F.min(c).alias(c) for c in ("low", "pair_low", "target_low")],
        *[F.max(c).alias(c) for c in ("high", "pair_high", "target_high")],
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    sketch = F.when(F.col("numeric"), F.col("_sketch")).alias("sketch")
    order = [field.split(":")[0] for field in LINE.split(", ")]
    return merged.withColumn("sketch", sketch).select(*by, *order)


@dataclass(frozen=True)
class Fitted:
    """Stored lines of all sources, and the reports they hold."""

    lines: DataFrame
    by: tuple[str, ...]

    @classmethod
    def of(cls, tables: Tables, by: Sequence[str] = (), aliases: Sequence[str] = presets.TARGET_ALIASES) -> Fitted:
        """Read the sources once and store the lines, sources x columns of them."""
        return cls(materialize(moments(tables, by, aliases), "moments"), tuple(source_keys(tables, by)))

    @cached_property
    def _rows(self) -> list[dict]:
        return [r.asDict() for r in self.lines.collect()]

    def rows(self) -> dict[str, int]:
        """Rows of each source, for tables that are told apart by one key."""
        return {line[self.by[0]]: line["rows"] for line in self._rows}

    def missing_report(self) -> DataFrame:
        gaps = (F.col("rows") - F.col("present")).alias("missing_count")
        report = self.lines.select(*self.by, "column", "dtype", gaps, F.col("rows").alias("row_count"))
        return report.withColumn("missing_rate_pct", F.round(F.try_divide("missing_count", "row_count") * 100, 2))

    def profile(self) -> DataFrame:
        """The structure report but for duplicates, which need a pass of their own."""
        counted = self.lines.groupBy(*self.by).agg(
            F.max("rows").alias("rows"),
            F.sum(F.col("rows") - F.col("present")).alias("total_missing"),
            F.count(F.lit(1)).cast("int").alias("columns"),
            F.count_if("numeric").cast("int").alias("numeric_columns"),
            F.count_if(~F.col("numeric")).cast("int").alias("categorical_columns"),
            F.max("target").alias("target_column"),
            F.sort_array(F.collect_list(F.struct("place", "column", "dtype"))).alias("_types"),
        )
        rate = F.try_divide("total_missing", F.col("rows") * F.col("columns")) * 100
        named = F.transform("_types", lambda t: F.concat(t["column"], F.lit(": "), t["dtype"]))
        made = counted.withColumns({"missing_rate_global_pct": F.round(rate, 2), "dtypes": F.array_join(named, "; ")})
        return made.drop("_types")

    def correlations(self) -> DataFrame:
        spread = F.sqrt("pair_squares") * F.sqrt("target_squares")
        vary = (F.col("pair_low") < F.col("pair_high")) & (F.col("target_low") < F.col("target_high"))
        r = F.when((F.col("pairs") >= 2) & vary, F.try_divide("products", spread)).alias("pearson_r")
        found = self.lines.filter("pairs is not null").select(
            *self.by, "target", F.col("column").alias("variable"), r, F.abs(r).alias("abs_r"), F.col("pairs").alias("n_valid")
        )
        assert [f.name for f in found.schema][len(self.by):] == [f.split()[0] for f in CORRELATION_SCHEMA.split(", ")]
        return found

    def imputation(self, median_above: float) -> DataFrame:
        """Rate, gaps, method and mean of each numeric column."""
        gaps = (F.col("rows") - F.col("present")).alias("missing_before")
        counted = self.lines.filter("numeric").select(*self.by, "column", gaps, "rows", "present", "mean")
        rate = F.try_divide("missing_before", "rows")
        method = F.when(F.col("missing_before") == 0, "no_missing").when(rate > median_above, "median").otherwise("mean")
        return counted.withColumns({"missing_rate_before_pct": F.round(rate * 100, 2), "method": method})

    def quantile_estimates(self, probabilities: Sequence[float]) -> DataFrame:
        """Approximate quantiles of every numeric column, with the rank error they may have."""
        asked = F.array(*[F.lit(float(p)) for p in probabilities])
        some = self.lines.filter("numeric AND present > 0")
        found = some.select(*self.by, "column", "present", F.kll_sketch_get_quantile_double("sketch", asked).alias("_q"))
        named = [F.col("_q")[i].alias(f"q{i}") for i in range(len(probabilities))]
        return found.select(*self.by, "column", "present", *named, F.lit(rank_error()).alias("rank_error"))


Ranks = Mapping[tuple[str, str], Sequence[int]]
Values = dict[tuple[str, str], dict[int, float]]


def exact_ranks(frames: Mapping[str, DataFrame], fitted: Fitted, ranks: Ranks) -> Values:
    """The values at the wanted zero-based ranks among the present values of (source, column).

    Some ranks per source and column are asked and answered; one scan of the rows in all but one of
    a hundred cases.
    """
    found: Values = {key: {} for key in ranks}
    size = {(r[SOURCE], r["column"]): r["present"] for r in fitted._rows if r["numeric"]}
    left = {key: sorted({r for r in wanted if 0 <= r < size[key]}) for key, wanted in ranks.items()}
    margin = 2 * rank_error()
    while left := {key: wanted for key, wanted in left.items() if wanted}:
        spans = _spans(fitted, left, size, margin)
        counted = _counted(frames, spans)
        for key, values in _at_ranks(counted, left).items():
            found[key] |= values
        left = {key: [r for r in wanted if r not in found[key]] for key, wanted in left.items()}
        margin *= 8
    return found


def _spans(fitted: Fitted, left: Ranks, size: Mapping, margin: float) -> dict[tuple[str, str], list[tuple[float, float]]]:
    """Disjoint value intervals, in order, that hold the wanted ranks unless the sketch is further off."""
    lines = [r for r in fitted._rows if (r[SOURCE], r["column"]) in left]
    asked = []
    for line in lines:
        key = (line[SOURCE], line["column"])
        last = max(size[key] - 1, 1)
        asked.append([min(max(r / last + side, 0.0), 1.0) for r in left[key] for side in (-margin, margin)])
    spark = fitted.lines.sparkSession
    sketches = spark.createDataFrame([tuple(r["sketch"] for r in lines)], ", ".join(f"s{i} binary" for i in range(len(lines))))
    ends = [F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(p) for p in wanted])) for i, wanted in enumerate(asked)]
    values = sketches.select(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
    spans = {}
    for line, wanted, at in zip(lines, asked, values):
        # An end at the first or last rank is the exact least or greatest value.
        ends = [line["low"] if p <= 0 else line["high"] if p >= 1 else v for p, v in zip(wanted, at)]
        merged: list[tuple[float, float]] = []
        for low, high in sorted(zip(ends[::2], ends[1::2])):
            if merged and low <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        spans[(line[SOURCE], line["column"])] = merged
    return spans


def _counted(frames: Mapping[str, DataFrame], spans: Mapping) -> DataFrame:
    """(source, column, slot, value, n): values inside a span one by one, the others by where they lie."""
    parts = []
    for source, df in frames.items():
        # As SQL text, because a column of so many branches would take a driver call for each.
        cells = [
            _placed(name, is_float(df.schema[name].dataType), intervals) for (of, name), intervals in spans.items() if of == source
        ]
        if cells:
            listed = df.select(F.lit(source).alias(SOURCE), F.expr(f"inline(array({', '.join(cells)}))")).filter("slot is not null")
            parts.append(listed.groupBy(SOURCE, "column", "slot", "value").agg(F.count(F.lit(1)).alias("n")))
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return materialize(counted, "counted")


def _placed(name: str, may_be_nan: bool, intervals: Sequence[tuple[float, float]]) -> str:
    """A cell's column, the slot of its value (odd inside a span), and the value if it is inside one."""
    bare = "`" + name.replace("`", "``") + "`"
    value = f"CAST({f'nanvl({bare}, NULL)' if may_be_nan else bare} AS DOUBLE)"
    steps = [f"WHEN {value} < {_number(low)} THEN {2 * i} WHEN {value} <= {_number(high)} THEN {2 * i + 1}" for i, (low, high) in enumerate(intervals)]
    slot = f"CASE WHEN {value} IS NULL THEN NULL {' '.join(steps)} ELSE {2 * len(intervals)} END"
    inside = " OR ".join(f"{value} BETWEEN {_number(low)} AND {_number(high)}" for low, high in intervals)
    text = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"named_struct('column', '{text}', 'slot', {slot}, 'value', CASE WHEN {inside} THEN {value} END)"


def _number(value: float) -> str:
    return f"{value!r}D" if isfinite(value) else f"CAST('{value}' AS DOUBLE)"


def _at_ranks(counted: DataFrame, left: Ranks) -> Values:
    """The value at each wanted rank that lies inside a span. Few ranks per column are asked and collected."""
    # Whole slots first, so that the window inside a slot is one of the few that hold a rank.
    slots = counted.groupBy(SOURCE, "column", "slot").agg(F.sum("n").alias("n")).collect()
    before: dict[tuple[str, str], list[tuple[int, int, int]]] = {}
    for row in sorted(slots, key=lambda r: r["slot"]):
        sums = before.setdefault((row[SOURCE], row["column"]), [])
        start = sums[-1][2] if sums else 0
        sums.append((row["slot"], start, start + row["n"]))
    wanted = [
        (*key, slot, r, r - start)
        for key, ranks in left.items()
        for r in ranks
        for slot, start, end in before.get(key, [])
        if start <= r < end and slot % 2
    ]
    if not wanted:
        return {}
    spark = counted.sparkSession
    asked = spark.createDataFrame(wanted, f"{SOURCE} string, column string, slot int, rank bigint, offset bigint")
    of = Window.partitionBy(SOURCE, "column", "slot").orderBy("value")
    spans = counted.withColumn("_end", F.sum("n").over(of))
    # One row per wanted rank.
    hits = spans.join(F.broadcast(asked), [SOURCE, "column", "slot"]).filter("offset < _end AND offset >= _end - n")
    out: Values = {}
    for row in hits.select(SOURCE, "column", "rank", "value").collect():
        out.setdefault((row[SOURCE], row["column"]), {})[row["rank"]] = row["value"]
    return out


def filled_at(values: Mapping[int, float], rank: int, gaps: int, fill: float | None) -> float:
    """The value at a rank of the present values with ``gaps`` times ``fill`` among them."""
    if fill is None or not gaps:
        return values[rank]
    if rank in values and values[rank] <= fill:
        return values[rank]
    if rank - gaps in values and values[rank - gaps] >= fill:
        return values[rank - gaps]
    return fill


def ranks_around(probability: float, size: int) -> tuple[int, int]:
    """The ranks between which a linearly interpolated quantile lies."""
    position = probability * (size - 1)
    return floor(position), ceil(position)


def between(probability: float, size: int, low: float, high: float) -> float:
    share = probability * (size - 1) - floor(probability * (size - 1))
    return low if low == high else low * (1 - share) + high * share

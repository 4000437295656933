"""Profiling reports: structure, missing values, duplicates, correlations, outliers.

Every report takes ``by``, the columns that name the source, and returns one row per source
or per source and column. Instead of one table, unlike tables may come as a dict; ``by`` is
then ignored and the name of the table stands in ``source``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe import presets
from tallyframe.functions.cast import is_float, is_numeric, numeric_columns, present, ref, unpivoted
from tallyframe.operators.attach import attach, measure
from tallyframe.operators.quantiles import DIRECT_VALUES, long_values, quantiles

SOURCE = "source"


def data_columns(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in by]


def cell(df: DataFrame, name: str) -> Column:
    return present(name, df.schema[name].dataType)


Tables = DataFrame | Mapping[str, DataFrame]


def source_keys(tables: Tables, by: Sequence[str]) -> list[str]:
    return list(by) if isinstance(tables, DataFrame) else [SOURCE]


def stacked(
    tables: Tables, by: Sequence[str], make: Callable[[DataFrame, list[str]], DataFrame]
) -> DataFrame:
    """``make`` over one table, or over each unlike table with its name in ``source``.

    The parts have one schema, so all sources go through the same few jobs as one lazy union.
    A report aggregates each unlike table without a key, so one without rows keeps its line.
    """
    if isinstance(tables, DataFrame):
        return make(tables, list(by))
    parts = [make(df.drop(SOURCE), []).select(F.lit(name).alias(SOURCE), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def folded_name(name: str) -> str:
    folded = name.strip().lower()
    for mark in (" ", "-", "/"):
        folded = folded.replace(mark, "_")
    return folded


def find_target(columns: Sequence[str], aliases: Sequence[str] = presets.TARGET_ALIASES) -> str | None:
    """The score column: the first alias, in alias order, among the folded names."""
    by_name = {folded_name(c): c for c in columns}
    return next((by_name[alias] for alias in aliases if alias in by_name), None)


def missing_report(tables: Tables, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and rate of every column: one scan, one wide aggregate, unpivoted after."""
    return stacked(tables, by, lambda df, keys: _missing_report(df, keys, columns))


def _missing_report(df: DataFrame, by: list[str], columns: Sequence[str] | None) -> DataFrame:
    names = list(columns) if columns is not None else data_columns(df, by)
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(cell(df, name)).alias(f"_n{i}") for i, name in enumerate(names)],
    )
    lines = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("missing_count"),
            F.col("_rows").alias("row_count"),
        )
        for i, name in enumerate(names)
    ]
    fields = "column: string, dtype: string, missing_count: bigint, row_count: bigint"
    return counted.select(*by, unpivoted(lines, fields)).withColumn(
        "missing_rate_pct", F.round(F.try_divide("missing_count", "row_count") * 100, 2)
    )


def duplicate_rows(tables: Tables, by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    Digests first: each row is shuffled as its source and two 64-bit hashes, and copies meet in the
    map-side aggregate. Only rows whose digests met are read again and compared whole, so unlike rows
    with one digest are never counted. The digests are counted when this is called.
    """
    keys = source_keys(tables, by)
    frames = {"": tables} if isinstance(tables, DataFrame) else {n: df.drop(SOURCE) for n, df in tables.items()}
    of = list(by) if isinstance(tables, DataFrame) else []
    hashed = {name: _with_digests(df, name, of) for name, df in frames.items()}
    digests = reduce(DataFrame.union, [df.select(*_DIGESTS) for df in hashed.values()])
    met = digests.groupBy(*_DIGESTS).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = measure(met.select(*_DIGESTS), _DIGESTS)

    def counted(name: str, df: DataFrame) -> DataFrame:
        rows = [c for c in df.columns if c not in _DIGESTS]
        found = attach(df, met, "left_semi").groupBy(*[ref(c) for c in rows]).agg((F.count(F.lit(1)) - 1).alias("_more"))
        # Every source keeps its line, whether or not some of its rows met.
        sources = frames[name].groupBy(*of).agg(F.lit(0).cast("bigint").alias("_more"))
        both = found.select(*of, "_more").unionByName(sources)
        total = both.groupBy(*of).agg(F.sum("_more").alias("duplicate_rows"))
        return total if isinstance(tables, DataFrame) else total.select(F.lit(name).alias(SOURCE), "duplicate_rows")

    return reduce(DataFrame.unionByName, [counted(*item) for item in hashed.items()]).select(*keys, "duplicate_rows")


_DIGESTS = ("_digest1", "_digest2")


def _with_digests(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """The rows as they are compared, with two hashes of their source and cells."""

    def plain(column: str) -> Column:
        # Zeros of both signs are equal, so their hashes have to be.
        dtype = df.schema[column].dataType
        return cell(df, column) + F.lit(0).cast(dtype) if is_float(dtype) else cell(df, column)

    rows = df.select(*by, *[plain(c).alias(c) for c in data_columns(df, by)])
    cells = [ref(c) for c in rows.columns]
    return rows.withColumns({d: F.xxhash64(F.lit(seed), F.lit(name), *cells) for seed, d in enumerate(_DIGESTS)})


def profile(
    tables: Tables, by: Sequence[str] = (), aliases: Sequence[str] = presets.TARGET_ALIASES
) -> DataFrame:
    """Rows, columns by type, duplicates, missing total and mean rate, score column."""
    return structure_report(tables, by, aliases).drop("dtypes")


def _profile(df: DataFrame, by: list[str], aliases: Sequence[str]) -> DataFrame:
    names = data_columns(df, by)
    numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
    gaps = [F.count_if(cell(df, n).isNull()) for n in names]
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), reduce(Column.__add__, gaps).alias("total_missing")
    )
    rate = F.try_divide(F.col("total_missing"), F.col("rows") * len(names)) * 100
    described = counted.withColumns(
        {
            "columns": F.lit(len(names)),
            "numeric_columns": F.lit(len(numeric)),
            "categorical_columns": F.lit(len(names) - len(numeric)),
            "missing_rate_global_pct": F.round(rate, 2),
            "target_column": F.lit(find_target(names, aliases)).cast("string"),
        }
    )
    types = "; ".join(f"{n}: {df.schema[n].dataType.simpleString()}" for n in names)
    return described.withColumn("dtypes", F.lit(types))


def _side_by_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables joined by their keys; without keys each is one row, and no join is needed."""
    if keys:
        return left.join(right, keys)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(f"`{c}`").alias(c) for c in both.columns])


def structure_report(
    tables: Tables, by: Sequence[str] = (), aliases: Sequence[str] = presets.TARGET_ALIASES
) -> DataFrame:
    """The profile plus the column types as text."""
    described = stacked(tables, by, lambda df, keys: _profile(df, keys, aliases))
    return _side_by_side(described, duplicate_rows(tables, by), source_keys(tables, by))


def missing_totals(tables: Tables, by: Sequence[str] = ()) -> DataFrame:
    keys = source_keys(tables, by)
    return missing_report(tables, by).groupBy(*keys).agg(F.sum("missing_count").alias("missing"))


def compare_missing(before: Tables, after: Tables, by: Sequence[str] = ()) -> DataFrame:
    """Missing cells per source before and after a treatment."""
    old = missing_totals(before, by).withColumnRenamed("missing", "missing_before")
    new = missing_totals(after, by).withColumnRenamed("missing", "missing_after")
    return _side_by_side(old, new, source_keys(before, by)).withColumn(
        "missing_removed", F.col("missing_before") - F.col("missing_after")
    )


CORRELATION_SCHEMA = "target string, variable string, pearson_r double, abs_r double, n_valid bigint"


def correlations(
    tables: Tables,
    by: Sequence[str] = (),
    target: str | None = None,
    columns: Sequence[str] | None = None,
    aliases: Sequence[str] = presets.TARGET_ALIASES,
) -> DataFrame:
    """Pearson r of every numeric column with the score, over rows where both are present.

    Built from moments, because ``corr`` fails the job on a constant column. All columns
    come from one aggregate. A table without a numeric score column adds no row.
    """
    return stacked(tables, by, lambda df, keys: _correlations(df, keys, target, columns, aliases))


def _correlations(df, by, target, columns, aliases) -> DataFrame:
    target = target or find_target(data_columns(df, by), aliases)
    numeric = numeric_columns(df, exclude=by)
    names = [n for n in (columns or numeric) if n != target]
    if target is None or target not in numeric or not names:
        empty = df.sparkSession.createDataFrame([], CORRELATION_SCHEMA)
        keys = [F.lit(None).cast(df.schema[name].dataType).alias(name) for name in by]
        return empty.select(*keys, "*")
    y = cell(df, target).cast("double")
    aggregates = []
    for i, name in enumerate(names):
        x = cell(df, name).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, yy = F.when(both, x), F.when(both, y)
        spread = F.stddev_pop(x) * F.stddev_pop(yy)
        # Whether one side is constant is told by its ends: a variance keeps a trace of rounding.
        vary = (F.min(x) < F.max(x)) & (F.min(yy) < F.max(yy))
        aggregates += [
            F.when(vary, F.try_divide(F.covar_pop(x, yy), spread)).alias(f"_r{i}"),
            F.count(x).alias(f"_n{i}"),
        ]
    lines = [
        F.struct(
            F.lit(target).alias("target"),
            F.lit(name).alias("variable"),
            F.when(F.col(f"_n{i}") >= 2, F.col(f"_r{i}")).alias("pearson_r"),
            F.abs(F.when(F.col(f"_n{i}") >= 2, F.col(f"_r{i}"))).alias("abs_r"),
            F.col(f"_n{i}").alias("n_valid"),
        )
        for i, name in enumerate(names)
    ]
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*lines)))


def numeric_values(tables: Tables, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Every number as ``(by, column, value)``, over all given columns or all numeric ones."""
    return stacked(
        tables,
        by,
        lambda df, keys: long_values(df, keys, columns or numeric_columns(df, exclude=keys)),
    )


def outlier_report(
    tables: Tables,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    multiplier: float = 1.5,
    direct_values: int = DIRECT_VALUES,
) -> DataFrame:
    """Quartiles, fences at ``multiplier`` ranges, and the values strictly outside them."""
    values = numeric_values(tables, by, columns)
    keys = [*source_keys(tables, by), "column"]
    # Rows per source bound the values of each column; this pass reads the source key only.
    rows = stacked(tables, by, lambda df, group: df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")))
    largest = rows.agg(F.max("n")).first()[0] or 0
    quartiles = quantiles(values, keys, (0.25, 0.75), direct_values, largest)
    span = F.col("q1") - F.col("q0")
    fences = measure(
        quartiles.select(
            *keys,
            "valid_count",
            F.col("q0").alias("q1"),
            F.col("q1").alias("q3"),
            span.alias("iqr"),
            (F.col("q0") - multiplier * span).alias("lower_bound"),
            (F.col("q1") + multiplier * span).alias("upper_bound"),
        ),
        keys,
    )
    value = F.col("value")
    outside = (value < F.col("lower_bound")) | (value > F.col("upper_bound"))
    counted = (
        attach(values, fences, "inner").groupBy(*keys).agg(F.count(F.when(outside, 1)).alias("outlier_count"))
    )
    rate = F.col("outlier_count") / F.col("valid_count") * 100
    return attach(counted, fences, "inner").select(
        *keys,
        "valid_count",
        "outlier_count",
        F.round(rate, 2).alias("outlier_rate_pct"),
        "q1", "q3", "iqr", "lower_bound", "upper_bound",
    )


def low_correlation_candidates(found: DataFrame, threshold: float = 0.2, limit: int = 40) -> DataFrame:
    """The weakest correlations first; unlike pruning, no column is protected here."""
    by = [c for c in found.columns if c not in ("target", "variable", "pearson_r", "abs_r", "n_valid")]
    weak = found.filter(F.col("abs_r") < threshold)
    return weak.orderBy("abs_r", *by, "variable").limit(limit)


def top_missing(report: DataFrame, by: Sequence[str], n: int = 12) -> DataFrame:
    """The ``n`` columns with most gaps of each source; ties by column name."""
    ranked = Window.partitionBy(*by).orderBy(F.desc("missing_count"), "column")
    return report.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)

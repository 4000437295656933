"""Cleaning: pruning, imputation, category filling and capping, each with its log.

Every step is fitted first, on statistics of at most sources x columns rows, and then
applied as plain expressions. Fitting runs jobs; applying is lazy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tallyframe import presets
from tallyframe.functions.cast import clip, numeric_columns, ref, text_columns, unpivoted
from tallyframe.operators.attach import attach, measure
from tallyframe.operators.profile import (
    SOURCE,
    Tables,
    cell,
    missing_report,
    numeric_values,
    source_keys,
    stacked,
)
from tallyframe.operators.quantiles import DIRECT_VALUES, quantiles

MEDIAN_ABOVE = 0.05


# --- Pruning -----------------------------------------------------------------------


def weak_columns(
    found: DataFrame,
    threshold: float = 0.2,
    protected: Sequence[str] = presets.PROTECTED_COLUMNS,
) -> DataFrame:
    """The correlations that lead to a dropped column; a null correlation does not."""
    weak = found.filter((F.col("abs_r") < threshold) & ~F.col("variable").isin(*protected))
    reason = f"Pearson |r| < {threshold}: faible correlation avec le target."
    return weak.withColumns({"threshold": F.lit(threshold), "justification": F.lit(reason)})


def drop_weak(frames: Mapping[str, DataFrame], weak: DataFrame) -> dict[str, DataFrame]:
    """Drop each source's weak columns.

    Reads the drop list (at most sources x columns names): a schema cannot depend on data
    in a lazy plan.
    """
    drops: dict[str, list[str]] = {}
    for row in weak.select(SOURCE, "variable").collect():
        drops.setdefault(row[0], []).append(row[1])
    return {name: df.drop(*drops.get(name, [])) for name, df in frames.items()}


# --- Numeric imputation ---------------------------------------------------------------


def imputation_stats(
    tables: Tables,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    median_above: float = MEDIAN_ABOVE,
    direct_values: int = DIRECT_VALUES,
) -> DataFrame:
    """Per source and numeric column: rate, method and value of the imputation.

    Medians are taken only where the rate asks for them: the rows of other columns are
    dropped before the quantile passes.
    """
    keys = [*source_keys(tables, by), "column"]
    counted = stacked(tables, by, lambda df, group: _counts_and_means(df, group, columns))
    rate = F.try_divide("missing_before", "row_count")
    described = measure(
        counted.withColumns(
            {
                "missing_rate_before_pct": F.round(rate * 100, 2),
                "method": F.when(F.col("missing_before") == 0, "no_missing")
                .when(rate > median_above, "median")
                .otherwise("mean"),
            }
        ),
        keys,
    )
    asked = described.table.filter((F.col("method") == "median") & F.col("mean").isNotNull())
    largest = asked.agg(F.max(F.col("row_count") - F.col("missing_before"))).first()[0] or 0
    asked = measure(asked.select(*keys), keys)
    medians = quantiles(
        attach(numeric_values(tables, by, columns), asked, "inner"), keys, (0.5,), direct_values, largest
    ).select(*keys, F.col("q0").alias("median"))
    value = F.when(F.col("method") == "median", F.col("median")).when(
        F.col("method") == "mean", F.col("mean")
    )
    return described.table.join(medians, keys, "left").select(
        *keys, "missing_rate_before_pct", "missing_before", "method", value.alias("imputation_value")
    )


def _counts_and_means(df: DataFrame, by: list[str], columns: Sequence[str] | None) -> DataFrame:
    names = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(cell(df, n)).alias(f"_n{i}") for i, n in enumerate(names)],
        *[F.avg(cell(df, n).cast("double")).alias(f"_m{i}") for i, n in enumerate(names)],
    )
    lines = [
        F.struct(
            F.lit(n).alias("column"),
            (F.col("_rows") - F.col(f"_n{i}")).alias("missing_before"),
            F.col("_rows").alias("row_count"),
            F.col(f"_m{i}").alias("mean"),
        )
        for i, n in enumerate(names)
    ]
    fields = "column: string, missing_before: bigint, row_count: bigint, mean: double"
    return counted.select(*by, unpivoted(lines, fields))


def imputation_log(stats: DataFrame) -> DataFrame:
    """The stats plus what stays missing: everything where no value could be found."""
    left = F.when(F.col("imputation_value").isNull(), F.col("missing_before")).otherwise(F.lit(0))
    return stats.withColumn("missing_after", left.cast("bigint"))


def _one_row_per_source(stats: DataFrame, by: Sequence[str], names: Sequence[str], values: Mapping[str, str]):
    """Stats of many columns as one row per source, for a single keyed join."""
    picked = [
        F.max(F.when(F.col("column") == name, F.col(value))).alias(f"{prefix}{i}")
        for prefix, value in values.items()
        for i, name in enumerate(names)
    ]
    return measure(stats.groupBy(*by).agg(*picked), by)


def impute_numeric(df: DataFrame, stats: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Fill numeric gaps with the fitted values; the columns become doubles."""
    by = list(by)
    names = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    filled = attach(df, _one_row_per_source(stats, by, names, {"_fill": "imputation_value"}))
    made = {n: F.coalesce(cell(df, n).cast("double"), F.col(f"_fill{i}")) for i, n in enumerate(names)}
    return filled.withColumns(made).select(*[ref(c) for c in df.columns])


# --- Categorical filling ----------------------------------------------------------------


def category_stats(
    tables: Tables,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    default: str = presets.MISSING_CATEGORY,
) -> DataFrame:
    """Per source and text column with gaps: the gap count and the replacement.

    The replacement is the most frequent value, the smallest one on a tie. Values are
    counted as ordinary groups, so free text of any variety stays spread over tasks.
    Columns without gaps are not even counted.
    """
    keys = [*source_keys(tables, by), "column"]
    report = stacked(
        tables, by, lambda df, group: missing_report(df, group, columns or text_columns(df, exclude=group))
    )
    gaps = measure(report.filter("missing_count > 0").select(*keys, "missing_count"), keys)
    values = stacked(tables, by, lambda df, group: _text_values(df, group, columns))
    counted = attach(values, measure(gaps.table.select(*keys), keys), "inner")
    counted = counted.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    first = counted.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col("value").alias("value"))).alias("_m"))
    return gaps.table.join(first, keys, "left").select(
        *keys,
        "missing_count",
        F.coalesce(F.col("_m.value"), F.lit(default)).alias("replacement"),
    )


def _text_values(df: DataFrame, by: list[str], columns: Sequence[str] | None) -> DataFrame:
    names = list(columns) if columns is not None else text_columns(df, exclude=by)
    cells = [F.struct(F.lit(n).alias("column"), ref(n).alias("value")) for n in names]
    listed = df.select(*by, unpivoted(cells, "column: string, value: string"))
    return listed.filter(F.col("value").isNotNull())


def fill_categories(df: DataFrame, stats: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    by = list(by)
    names = list(columns) if columns is not None else text_columns(df, exclude=by)
    filled = attach(df, _one_row_per_source(stats, by, names, {"_fill": "replacement"}))
    made = {n: F.coalesce(ref(n), F.col(f"_fill{i}")) for i, n in enumerate(names)}
    return filled.withColumns(made).select(*[ref(c) for c in df.columns])


# --- Capping ------------------------------------------------------------------------------


def cap_outliers(df: DataFrame, bounds: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Pull numeric values to the bounds of their source and column; missing stays missing.

    ``bounds`` is an outlier report. Columns it does not list are left alone.
    """
    by = list(by)
    names = list(columns) if columns is not None else numeric_columns(df, exclude=by)
    limits = _one_row_per_source(bounds, by, names, {"_lo": "lower_bound", "_hi": "upper_bound"})
    bounded = attach(df, limits)
    made = {
        n: clip(cell(df, n).cast("double"), F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        for i, n in enumerate(names)
    }
    return bounded.withColumns(made).select(*[ref(c) for c in df.columns])


def correction_log(categories: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """What was corrected: filled categories and capped outliers, one row per column."""
    by = list(by)
    filled = categories.select(
        *by,
        "column",
        F.lit("missing_categorical").alias("issue"),
        F.col("missing_count").alias("count_before"),
        F.col("missing_count").alias("count_corrected"),
        F.lit("mode").alias("method"),
        F.col("replacement").alias("value"),
    )
    fences = F.concat(
        F.lit("["), F.col("lower_bound").cast("string"), F.lit(", "),
        F.col("upper_bound").cast("string"), F.lit("]"),
    )
    capped = bounds.filter("outlier_count > 0").select(
        *by,
        "column",
        F.lit("numeric_outlier").alias("issue"),
        F.col("outlier_count").alias("count_before"),
        F.col("outlier_count").alias("count_corrected"),
        F.lit("clip_iqr_bounds").alias("method"),
        fences.alias("value"),
    )
    return filled.unionByName(capped)


# --- Unlike tables --------------------------------------------------------------------------


def _values_by_source(stats: DataFrame, *values: str) -> dict[str, dict[str, tuple]]:
    """Fitted values as scalars; at most sources x columns rows are read."""
    found: dict[str, dict[str, tuple]] = {}
    for row in stats.select(SOURCE, "column", *values).collect():
        found.setdefault(row[0], {})[row[1]] = tuple(row[2:])
    return found


def _with(df: DataFrame, made: dict) -> DataFrame:
    return df.withColumns(made) if made else df


def impute_all(frames: Mapping[str, DataFrame], direct_values: int = DIRECT_VALUES):
    """Impute unlike tables. Returns the tables and the log.

    The fitted values enter each table's plan as constants: no join, no extra stage.
    """
    stats = measure(imputation_stats(frames, direct_values=direct_values), [SOURCE, "column"]).table
    fitted = _values_by_source(stats, "imputation_value")
    out = {}
    for source, df in frames.items():
        made = {
            name: F.coalesce(cell(df, name).cast("double"), F.lit(value))
            for name, (value,) in fitted.get(source, {}).items()
            if value is not None
        }
        out[source] = _with(df, made)
    return out, imputation_log(stats)


def correct_all(frames: Mapping[str, DataFrame], bounds: DataFrame):
    """Fill categories and cap outliers of unlike tables. Returns the tables and the log."""
    stats = measure(category_stats(frames), [SOURCE, "column"]).table
    fills = _values_by_source(stats, "replacement")
    fences = _values_by_source(bounds.filter("outlier_count > 0"), "lower_bound", "upper_bound")
    out = {}
    for source, df in frames.items():
        made = {
            name: F.coalesce(ref(name), F.lit(value)) for name, (value,) in fills.get(source, {}).items()
        }
        made |= {
            name: clip(cell(df, name).cast("double"), F.lit(low), F.lit(high))
            for name, (low, high) in fences.get(source, {}).items()
        }
        out[source] = _with(df, made)
    return out, correction_log(stats, bounds, [SOURCE])

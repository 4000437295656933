"""Declarative row filters, applied per source before any union.

A filter on a column that a source lacks does nothing to that source: its rows stay.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyframe import presets
from tallyframe.functions.cast import num, present, ref, ts, ts_of
from tallyframe.functions.text import missing_text, strip, value_text


@dataclass(frozen=True)
class FilterSpec:
    """What to keep. Empty lists and ``None`` switch a filter off.

    ``values`` maps a column to its accepted values. ``chart_values`` holds the values
    clicked in a chart; they widen the list of ``chart_column`` (OR, not AND).
    """

    values: Mapping[str, Sequence[str]] = field(default_factory=dict)
    chart_values: Sequence[str] = ()
    chart_column: str = "pays"
    score_min: float | None = None
    score_max: float | None = None
    score_column: str = presets.SCORE_COLUMN
    date_start: str | None = None
    date_end: str | None = None
    date_columns: Sequence[str] = presets.DATE_COLUMNS
    search: str = ""
    search_literal: bool = False
    search_columns: Sequence[str] | None = None


def in_values(df: DataFrame, column: str, values: Sequence[str]) -> Column:
    """Trimmed, case-blind membership of the printed value; null never matches."""
    wanted = sorted({str(v).strip().lower() for v in values})
    printed = value_text(ref(column), df.schema[column].dataType)
    return F.lower(strip(printed)).isin(wanted)


def in_score_range(df: DataFrame, column: str, low: float | None, high: float | None) -> list[Column]:
    """Inclusive bounds; a missing score fails either one.

    A double is compared bare, which the scan can use. NaN sorts above all numbers, so the
    upper bound excludes it already.
    """
    dtype = df.schema[column].dataType
    bare = isinstance(dtype, T.DoubleType)
    score = ref(column) if bare else num(ref(column), dtype)
    conditions = []
    if low is not None:
        conditions.append(score >= F.lit(float(low)))
        if bare:
            conditions.append(~F.isnan(score))
    if high is not None:
        conditions.append(score <= F.lit(float(high)))
    return conditions


def in_date_range(df: DataFrame, column: str, start: str | None, end: str | None) -> list[Column]:
    """From the start to one second before the day after the end, both inclusive.

    A bound that is no date compares as null, so it keeps no row at all.
    """
    date = ts_of(df, column)
    conditions = []
    if start:
        conditions.append(date >= ts(F.lit(start)))
    if end:
        last = ts(F.lit(end)) + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '1' SECOND")
        conditions.append(date <= last)
    return conditions


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The whole row as one text, missing cells printed as a marker."""
    names = list(columns) if columns is not None else df.columns
    cells = []
    for name in names:
        dtype = df.schema[name].dataType
        cells.append(F.coalesce(value_text(present(name, dtype), dtype), F.lit(missing_text(dtype))))
    return F.concat_ws(" ", *cells)


def matches_search(
    df: DataFrame, needle: str, literal: bool = False, columns: Sequence[str] | None = None
) -> Column:
    """Search the printed row. The needle is a pattern and is lower-cased as a whole.

    Reads every searched column of every row; pass ``columns`` to narrow the scan.
    """
    pattern = needle.strip().lower()
    text = F.lower(row_text(df, columns))
    if literal:
        return text.contains(pattern)
    return text.rlike("(?U)" + pattern)


def conditions(df: DataFrame, spec: FilterSpec) -> list[Column]:
    """The conditions that apply to this schema, cheap typed ones first."""
    found: list[Column] = []
    if spec.score_column in df.columns:
        found += in_score_range(df, spec.score_column, spec.score_min, spec.score_max)
    date_column = next((c for c in spec.date_columns if c in df.columns), None)
    if date_column is not None:
        found += in_date_range(df, date_column, spec.date_start, spec.date_end)
    wanted = {column: list(values) for column, values in spec.values.items()}
    if spec.chart_values:
        wanted[spec.chart_column] = wanted.get(spec.chart_column, []) + list(spec.chart_values)
    for column, values in wanted.items():
        if values and column in df.columns:
            found.append(in_values(df, column, values))
    if spec.search.strip():
        columns = spec.search_columns
        if columns is not None:
            columns = [c for c in columns if c in df.columns]
        found.append(matches_search(df, spec.search, spec.search_literal, columns))
    return found


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    for condition in conditions(df, spec):
        df = df.filter(condition)
    return df


def apply_to_all(frames: Mapping[str, DataFrame], spec: FilterSpec) -> dict[str, DataFrame]:
    return {source: apply_filters(df, spec) for source, df in frames.items()}


def check_pattern(needle: str) -> None:
    """Reject a malformed search pattern before a job is started."""
    try:
        re.compile(needle.strip().lower())
    except re.error as error:
        raise ValueError(f"malformed search pattern: {error}") from error

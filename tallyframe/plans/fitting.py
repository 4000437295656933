"""Fitting all cleaning of unlike sources in three passes: moments, order statistics, tallies.

The first pass gives gaps, means, correlations and sketches. The second gives every exact order
statistic at once, also the quartiles of columns whose gaps will be filled: filling puts a known
number of equal values among the present ones, so a rank after it is a rank before it, or the
fill. The third counts the values of text columns with gaps and the numbers outside their fences.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyframe import presets
from tallyframe.functions.cast import clip, ref, text_columns
from tallyframe.operators.clean import MEDIAN_ABOVE, correction_log, imputation_log
from tallyframe.operators.moments import Fitted, between, exact_ranks, filled_at, ranks_around
from tallyframe.operators.profile import SOURCE, cell

Key = tuple[str, str]
QUARTILES = (0.25, 0.75)
STATS = (
    f"{SOURCE} string, column string, missing_rate_before_pct double, missing_before bigint, method string, "
    "imputation_value double"
)
FENCES = (
    f"{SOURCE} string, column string, valid_count bigint, outlier_count bigint, "
    "q1 double, q3 double, iqr double, lower_bound double, upper_bound double"
)
CATEGORIES = f"{SOURCE} string, column string, missing_count bigint, replacement string"


@dataclass(frozen=True)
class Cleaning:
    """Fitted cleaning: the filled and the corrected tables, and the logs of both steps."""

    imputed: dict[str, DataFrame]
    corrected: dict[str, DataFrame]
    imputation: DataFrame
    outliers: DataFrame
    corrections: DataFrame


def fit_cleaning(
    frames: Mapping[str, DataFrame],
    fitted: Fitted,
    median_above: float = MEDIAN_ABOVE,
    multiplier: float = 1.5,
    default: str = presets.MISSING_CATEGORY,
) -> Cleaning:
    """Impute numbers, fill categories and cap outliers of ``frames``, some or all columns of what was fitted."""
    spark = fitted.lines.sparkSession
    known = [r.asDict() for r in fitted.imputation(median_above).collect()]
    known = [r for r in known if r["column"] in frames[r[SOURCE]].columns]
    lines: dict[Key, dict] = {(r[SOURCE], r["column"]): r for r in known}

    values = exact_ranks(frames, fitted, {key: _wanted(line) for key, line in lines.items()})
    fills = {key: _fill(line, values[key]) for key, line in lines.items()}
    imputed = {
        source: _with(df, {c: F.coalesce(cell(df, c).cast("double"), F.lit(v)) for (s, c), v in fills.items() if s == source and v is not None})
        for source, df in frames.items()
    }
    stats = [
        (*key, line["missing_rate_before_pct"], line["missing_before"], line["method"], fills[key]) for key, line in lines.items()
    ]
    fences = _fences(lines, values, fills, multiplier)
    gaps = _text_gaps(frames, fitted)
    modes, outside = _tallies(imputed, gaps, fences)

    categories = [(*key, n, modes.get(key, default)) for key, n in gaps.items()]
    bounds, filled = _report(spark, fences, outside), spark.createDataFrame(categories, CATEGORIES)
    corrected = {}
    for source, df in imputed.items():
        made = {c: F.coalesce(ref(c), F.lit(mode)) for s, c, _, mode in categories if s == source}
        for (s, c), (*_, low, high) in fences.items():
            if s == source and outside.get((s, c)):
                made[c] = clip(cell(df, c).cast("double"), F.lit(low), F.lit(high))
        corrected[source] = _with(df, made)
    return Cleaning(
        imputed, corrected, imputation_log(spark.createDataFrame(stats, STATS)), bounds, correction_log(filled, bounds, [SOURCE])
    )


def fenced_outliers(frames: Mapping[str, DataFrame], fitted: Fitted, multiplier: float = 1.5) -> DataFrame:
    """The outlier report of the sources as they are: one pass for quartiles, one for counts."""
    known = [r.asDict() | {"missing_before": 0} for r in fitted.lines.filter("numeric").select(*fitted.by, "column", "present").collect()]
    lines = {(r[SOURCE], r["column"]): r | {"method": "no_missing"} for r in known}
    values = exact_ranks(frames, fitted, {key: _wanted(line) for key, line in lines.items()})
    fences = _fences(lines, values, {}, multiplier)
    _, outside = _tallies(frames, {}, fences)
    return _report(fitted.lines.sparkSession, fences, outside)


def _report(spark: SparkSession, fences: Mapping[Key, tuple], outside: Mapping[Key, int]) -> DataFrame:
    rows = [(*key, n, outside.get(key, 0), *rest) for key, (n, *rest) in fences.items()]
    rate = F.round(F.col("outlier_count") / F.col("valid_count") * 100, 2).alias("outlier_rate_pct")
    counted = spark.createDataFrame(rows, FENCES)
    return counted.select(*counted.columns[:4], rate, *counted.columns[4:])


def _with(df: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(made)) if made else df


def _size(line: Mapping) -> int:
    """Values of a column once its gaps are filled; a column without any value stays empty."""
    return line["present"] and line["present"] + line["missing_before"]


def _wanted(line: Mapping) -> list[int]:
    if not line["present"]:
        return []
    middle = ranks_around(0.5, line["present"]) if line["method"] == "median" else ()
    around = [r for q in QUARTILES for r in ranks_around(q, _size(line))]
    return [*middle, *around, *[r - line["missing_before"] for r in around]]


def _fill(line: Mapping, values: Mapping[int, float]) -> float | None:
    if line["method"] == "median" and line["present"]:
        low, high = ranks_around(0.5, line["present"])
        return between(0.5, line["present"], values[low], values[high])
    return line["mean"] if line["method"] == "mean" else None


def _fences(lines: Mapping[Key, Mapping], values: Mapping, fills: Mapping, multiplier: float) -> dict[Key, tuple]:
    """Count, quartiles, their distance and the fences of every column with a value."""
    out = {}
    for key, line in lines.items():
        n = _size(line)
        if not n:
            continue
        q1, q3 = (
            between(q, n, *[filled_at(values[key], r, line["missing_before"], fills.get(key)) for r in ranks_around(q, n)])
            for q in QUARTILES
        )
        span = q3 - q1
        out[key] = (n, q1, q3, span, q1 - multiplier * span, q3 + multiplier * span)
    return out


def _text_gaps(frames: Mapping[str, DataFrame], fitted: Fitted) -> dict[Key, int]:
    """The gaps of every text column that has some."""
    texts = {(source, c) for source, df in frames.items() for c in text_columns(df)}
    rows = fitted.missing_report().filter("missing_count > 0").collect()
    found = {(r[SOURCE], r["column"]): r["missing_count"] for r in rows}
    return {key: n for key, n in found.items() if key in texts}


def _tallies(frames: Mapping[str, DataFrame], gaps: Mapping[Key, int], fences: Mapping[Key, tuple]) -> tuple[dict, dict]:
    """The most frequent value of each text column asked, the smallest on a tie, and the numbers outside
    each pair of fences, by one pass. Values are counted as ordinary groups, so free text of any variety
    stays spread over tasks; one row per column is collected."""
    parts = []
    for source, df in frames.items():
        cells = [
            F.struct(F.lit(c).alias("column"), F.lit(True).alias("text"), ref(c).alias("value")) for s, c in gaps if s == source
        ]
        for (s, c), (*_, low, high) in fences.items():
            if s == source:
                value = cell(df, c).cast("double")
                side = F.when((value < F.lit(low)) | (value > F.lit(high)), F.lit("outside"))
                cells.append(F.struct(F.lit(c).alias("column"), F.lit(False).alias("text"), side.alias("value")))
        if cells:
            listed = df.select(F.lit(source).alias(SOURCE), F.inline(F.array(*cells))).filter("value is not null")
            parts.append(listed.groupBy(SOURCE, "column", "text", "value").agg(F.count(F.lit(1)).alias("n")))
    if not parts:
        return {}, {}
    counted = reduce(DataFrame.unionByName, parts)
    best = counted.groupBy(SOURCE, "column", "text").agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("m"))
    modes, outside = {}, {}
    for row in best.collect():
        if row["text"]:
            modes[(row[SOURCE], row["column"])] = row["m"]["value"]
        else:
            outside[(row[SOURCE], row["column"])] = -row["m"]["less"]
    return modes, outside

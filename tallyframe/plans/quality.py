"""Quality reports over the raw and the normalized sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.operators.moments import Fitted
from tallyframe.operators.profile import (
    SOURCE,
    duplicate_rows,
    low_correlation_candidates,
    top_missing,
)
from tallyframe.operators.schema import visible_columns
from tallyframe.plans.fitting import fenced_outliers
from tallyframe.sources.readers import SourceSet, read_tables


def normalized_profiles(sources: SourceSet) -> tuple[DataFrame, DataFrame]:
    """One row per declared source, and the twelve columns with most gaps of each.

    Lineage columns are not profiled. A source that cannot be read keeps a row with its error.
    """
    frames = {
        source: df.select(*visible_columns(df)) for source, df in sources.frames.items()
    }
    fitted = Fitted.of(frames)
    described = fitted.profile().join(duplicate_rows(frames), SOURCE).select(
        F.col(SOURCE).alias("id"), "rows", "columns", "duplicate_rows", "total_missing",
        F.col("missing_rate_global_pct").alias("missing_rate_pct"),
    )
    spark = described.sparkSession
    declared = spark.createDataFrame(
        [
            (s.id, s.label, s.kind, s.id in sources.frames, sources.errors.get(s.id))
            for s in sources.specs.values()
        ],
        "id string, source string, kind string, available boolean, error string",
    )
    # One row per declared source on both sides.
    return declared.join(described, "id", "left"), top_missing(fitted.missing_report(), [SOURCE])


def quality(raw: Mapping[str, DataFrame], sources: SourceSet | None = None, threshold: float = 0.2) -> dict[str, DataFrame]:
    """Structure, missing values, correlations, outliers and pruning candidates.

    The raw rows are read for moments, duplicates, quartiles and outlier counts, once each.
    """
    fitted = Fitted.of(raw)
    found = fitted.correlations()
    reports = {
        "structure": fitted.profile().join(duplicate_rows(raw), SOURCE),
        "missing": fitted.missing_report(),
        "correlations": found.orderBy(F.desc_nulls_last("abs_r"), SOURCE, "variable"),
        "low_correlation_candidates": low_correlation_candidates(found, threshold),
        "outliers": fenced_outliers(raw, fitted),
    }
    if sources is not None:
        reports["normalized"], reports["top_missing"] = normalized_profiles(sources)
    return reports


def quality_of_files(
    spark: SparkSession, paths: Mapping[str, str], sources: SourceSet | None = None, threshold: float = 0.2
) -> dict[str, DataFrame]:
    """``quality`` of raw files, with a one-row ``status``: raw_available and error.

    Where a file cannot be read, the raw reports have no rows, the status says why, and the
    normalized part is there all the same.
    """
    error = None
    try:
        raw = read_tables(spark, paths)
    except (PySparkException, ValueError) as failed:
        error = str(failed)
        raw = {SOURCE: spark.createDataFrame([], "value double")}
    reports = quality(raw, None, threshold)
    if error is not None:
        reports = {name: report.limit(0) for name, report in reports.items()}
    if sources is not None:
        reports["normalized"], reports["top_missing"] = normalized_profiles(sources)
    reports["status"] = spark.createDataFrame([(error is None, error)], "raw_available boolean, error string")
    return reports

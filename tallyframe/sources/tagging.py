"""Lineage columns and the coercions a source needs when it is loaded.

Pure column work: the same functions accept a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe import presets
from tallyframe.functions.cast import num_of, ts_of
from tallyframe.functions.scoring import product_from_code


def _lineage(df: DataFrame, spec) -> DataFrame:
    return df.withColumns(
        {
            "_source_id": F.lit(spec.id),
            "_source_label": F.lit(spec.label),
            "_kind": F.lit(spec.kind),
        }
    )


def tag_surveys(
    df: DataFrame,
    spec,
    date_column: str = "date_enquete",
    score_column: str = presets.SCORE_COLUMN,
) -> DataFrame:
    """Survey rows with lineage, date and score coerced where the columns exist.

    Columns of the right type are left bare: a wrapped one would hide from the scan's
    filters. The operators read NaN as missing themselves.
    """
    result = _lineage(df, spec)
    if date_column in df.columns:
        result = result.withColumn(date_column, ts_of(df, date_column))
    if score_column in df.columns and not isinstance(df.schema[score_column].dataType, T.DoubleType):
        result = result.withColumn(score_column, num_of(df, score_column))
    return result


def tag_claims(
    df: DataFrame,
    spec,
    date_column: str = "date_reclamation",
    code_column: str = "code_produit_global",
    codes: Mapping[str, str] = presets.CLAIM_PRODUCTS,
    pattern: str = presets.CLAIM_PRODUCT_PATTERN,
) -> DataFrame:
    """Claim rows with lineage, date coerced and the product derived from its code."""
    result = _lineage(df, spec)
    if date_column in df.columns:
        result = result.withColumn(date_column, ts_of(df, date_column))
    if code_column in df.columns:
        result = result.withColumn("produit_global", product_from_code(code_column, codes, pattern))
    return result

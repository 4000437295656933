"""Facts about a scope: totals, extremes, claims, and surveys against claims."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe import presets
from tallyframe.functions.cast import num_of, ref, round3, without_nan
from tallyframe.operators.metrics import (
    _has,
    _none,
    group_mean,
    group_totals,
    measured,
    survey_totals,
    value_counts,
)
from tallyframe.operators.schema import visible_columns

TOP_CATEGORIES = 8


def extreme_groups(df: DataFrame, group: str = "produit_global", score: str | None = presets.SCORE_COLUMN) -> DataFrame:
    """The weakest and the strongest group by mean; one row each, none without scores."""
    if not _has(df, group, score):
        return _none(df, "position string, label string, value double, count bigint")
    counted = measured(df.filter(ref(group).isNotNull()), [group], score).filter("scored > 0")
    line = F.struct(
        (F.col("total") / F.col("scored")).alias("mean"),
        ref(group).cast("string").alias("label"),
        F.col("scored").alias("count"),
    )
    ends = counted.agg(F.min(line).alias("weakest"), F.max(line).alias("strongest"))
    named = [F.struct(F.lit(n).alias("position"), F.col(n).alias("line")) for n in ("weakest", "strongest")]
    return (
        ends.select(F.inline(F.array(*named)))
        .filter("line is not null")
        .select("position", "line.label", round3(F.col("line.mean")).alias("value"), "line.count")
    )


def claim_facts(df: DataFrame, category: str = "categorie_reclamation", country: str = "pays", status: str = "statut_reclamation") -> DataFrame:
    """Claim total, the eight most frequent categories, and counts by country and status."""
    total = df.agg((F.sum("rows") if "rows" in df.columns else F.count(F.lit(1))).alias("value"))
    parts = [total.select(F.lit("total").alias("fact"), F.lit(None).cast("string").alias("label"), F.coalesce("value", F.lit(0)).alias("value"))]
    for fact, column, limit in (
        ("category", category, TOP_CATEGORIES),
        ("country", country, None),
        ("status", status, None),
    ):
        parts.append(value_counts(df, column, limit).select(F.lit(fact).alias("fact"), "label", "value"))
    return reduce(DataFrame.unionByName, parts)


def survey_facts(df: DataFrame, score: str | None = presets.SCORE_COLUMN, country: str = "pays", product: str = "produit_global") -> dict[str, DataFrame]:
    """Totals, countries best first, products worst first, and the two extreme products."""
    return {
        "totals": survey_totals(df, score, product),
        "by_country": group_mean(df, country, score),
        "by_product": group_mean(df, product, score, ascending=True),
        "extremes": extreme_groups(df, product, score),
    }


def global_statistics(df: DataFrame, score: str = presets.SCORE_COLUMN, product: str = "produit_global", country: str = "pays") -> dict[str, DataFrame]:
    """Totals and group totals; without the needed columns, a row count and their names."""
    needed = {product, score}
    lacking = sorted(needed - set(df.columns))
    if lacking:
        rows = df.agg(F.count(F.lit(1)).alias("responses"))
        return {"totals": rows.withColumn("unavailable", F.lit(", ".join(lacking)))}
    totals = df.agg(*_statistics(df, score))
    return {
        "totals": totals.withColumn("mean", round3(F.try_divide("total", "valid_scores"))).withColumn(
            "total", round3(F.col("total"))
        ),
        "by_product": group_totals(df, product, score),
        "by_country": group_totals(df, country, score),
    }


def _statistics(df: DataFrame, score: str):
    value = num_of(df, score)
    return [
        F.count(F.lit(1)).alias("responses"),
        F.count(value).alias("valid_scores"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
    ]


def surveys_against_claims(
    surveys: DataFrame,
    claims: DataFrame,
    group: str = "pays",
    score: str = presets.SCORE_COLUMN,
) -> DataFrame:
    """Mean score beside the claim count of each group.

    Surveys and claims share no row key, so only these aggregates are joined; a group seen on
    one side alone is kept.
    """
    means = group_mean(surveys, group, score).select(
        F.col("label").alias("group"), F.col("value").alias("mean"), F.col("count").alias("valid_scores")
    )
    counts = value_counts(claims, group).select(F.col("label").alias("group"), F.col("value").alias("claims"))
    return means.join(counts, "group", "full_outer")


def row_join_note() -> dict[str, object]:
    return {"row_join_possible": False, "reason": presets.NO_ROW_JOIN}


def evidence(frames: Mapping[str, DataFrame], order_keys: Mapping[str, str], limit: int = 8) -> DataFrame:
    """A few first rows of every source as JSON without empty fields, ``limit`` in all.

    "First" is by the source's order key: each source gives an equal share through its own
    bounded top-k, so no source is sorted or moved as a whole.
    """
    share = max(1, limit // max(len(frames), 1))
    parts = []
    for position, (source, df) in enumerate(frames.items()):
        first = without_nan(df.orderBy(ref(order_keys[source])).limit(share))
        fields = [ref(c) for c in visible_columns(df)]
        parts.append(
            first.select(
                F.lit(position).alias("position"),
                F.row_number().over(_order(order_keys[source])).alias("rank"),
                F.lit(source).alias("source"),
                F.to_json(F.struct(*fields, F.lit(source).alias("_source"))).alias("record"),
            )
        )
    return reduce(DataFrame.unionByName, parts).orderBy("position", "rank").limit(limit)


def _order(key: str):
    # Over at most ``limit`` rows: the top-k above has already been taken.
    return Window.partitionBy(F.lit(0)).orderBy(ref(key))

"""Scores and counts by group, by month and in total.

Each function takes raw rows, or a cube made by ``survey_cube`` / ``claim_cube`` (pass
``score=None``). A cube is one pass over the rows; all series of a dashboard are then sums
over it, so ten series cost one scan. Group means stay exact, because sums and counts add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe import presets
from tallyframe.functions.cast import month_key, num_of, ref, round3, ts_of

GOOD_SCORE = 4
# Base-2 logarithm of a distinct sketch's size: 4,096 places of half a byte to a byte.
DISTINCT_SIZE = 12


def _measures(df: DataFrame, score: str | None) -> list[Column]:
    if score is None:
        return [
            F.sum("rows").alias("rows"),
            F.sum("scored").alias("scored"),
            F.sum("total").alias("total"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.sum("good").alias("good"),
        ]
    value = num_of(df, score)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("scored"),
        F.sum(value).alias("total"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.count(F.when(value >= GOOD_SCORE, 1)).alias("good"),
    ]


def measured(df: DataFrame, keys: Sequence[str], score: str | None) -> DataFrame:
    """Row, score and total counts per group; partial sums are combined map-side."""
    return df.groupBy(*[ref(k) for k in keys]).agg(*_measures(df, score))


def _has(df: DataFrame, *names: str | None) -> bool:
    return all(n is None or n in df.columns for n in names)


def _none(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


# --- Cubes --------------------------------------------------------------------------------


def _key(df: DataFrame, name: str, expression: Column | None = None) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return (ref(name) if expression is None else expression).cast("string")


def survey_cube(
    df: DataFrame,
    score: str = presets.SCORE_COLUMN,
    country: str = "pays",
    product: str = "produit_global",
    date: str = "date_enquete",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Survey rows summed by country, product, month and rounded score.

    The size is bounded by the variety of the categories, not by the rows.
    """
    value = num_of(df, score) if score in df.columns else F.lit(None).cast("double")
    keyed = df.select(
        _key(df, country).alias("country"),
        _key(df, product).alias("product"),
        _key(df, date, month_key(ts_of(df, date)) if date in df.columns else None).alias("month"),
        F.bround(value).cast("int").alias("bucket"),
        value.alias("score"),
        *[ref(name) for name in extra],
    )
    return measured(keyed, ["country", "product", "month", "bucket", *extra], "score")


def claim_cube(
    df: DataFrame,
    category: str = "categorie_reclamation",
    country: str = "pays",
    status: str = "statut_reclamation",
    date: str = "date_reclamation",
    sla: str = "sla_respecte",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Claim rows counted by category, country, status and month."""
    met = sla_met(ref(sla)) if sla in df.columns else F.lit(None).cast("boolean")
    keyed = df.select(
        _key(df, category).alias("category"),
        _key(df, country).alias("country"),
        _key(df, status).alias("status"),
        _key(df, date, month_key(ts_of(df, date)) if date in df.columns else None).alias("month"),
        met.alias("met"),
        *[ref(name) for name in extra],
    )
    return keyed.groupBy("category", "country", "status", "month", *extra).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("met").alias("sla_rows"),
        F.count(F.when(F.col("met"), 1)).alias("sla_met"),
    )


# --- Series -------------------------------------------------------------------------------


def group_mean(
    df: DataFrame,
    group: str,
    score: str | None = presets.SCORE_COLUMN,
    ascending: bool = False,
) -> DataFrame:
    """Mean and count of the valid scores per group, best (or worst) first; ties by name."""
    if not _has(df, group, score):
        return _none(df, "label string, value double, count bigint")
    counted = measured(df.filter(ref(group).isNotNull()), [group], score).filter("scored > 0")
    mean = F.col("total") / F.col("scored")
    return (
        counted.select(
            ref(group).cast("string").alias("label"),
            round3(mean).alias("value"),
            F.col("scored").alias("count"),
            mean.alias("_mean"),
        )
        .orderBy(F.asc("_mean") if ascending else F.desc("_mean"), "label")
        .drop("_mean")
    )


def group_totals(df: DataFrame, group: str, score: str | None = presets.SCORE_COLUMN) -> DataFrame:
    """Count, sum and mean of the valid scores per group, best mean first."""
    if not _has(df, group, score):
        return _none(df, "label string, count bigint, total double, mean double")
    counted = measured(df.filter(ref(group).isNotNull()), [group], score).filter("scored > 0")
    mean = F.col("total") / F.col("scored")
    return (
        counted.select(
            ref(group).cast("string").alias("label"),
            F.col("scored").alias("count"),
            round3(F.col("total")).alias("total"),
            round3(mean).alias("mean"),
            mean.alias("_mean"),
        )
        .orderBy(F.desc("_mean"), "label")
        .drop("_mean")
    )


def _rows(df: DataFrame) -> Column:
    return F.sum("rows") if "rows" in df.columns else F.count(F.lit(1))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per non-null value as text, most frequent first; ties by value."""
    if not _has(df, column):
        return _none(df, "label string, value bigint")
    label = ref(column).cast("string").alias("label")
    counted = df.filter(ref(column).isNotNull()).groupBy(label).agg(_rows(df).alias("value"))
    ordered = counted.orderBy(F.desc("value"), "label")
    return ordered.limit(limit) if limit is not None else ordered


def monthly_mean(
    df: DataFrame, date: str = "date_enquete", score: str | None = presets.SCORE_COLUMN
) -> DataFrame:
    """Mean and count per month that has scores, in month order; gaps are not filled."""
    if not _has(df, date, score):
        return _none(df, "label string, value double, count bigint")
    month = ref(date) if score is None else month_key(ts_of(df, date))
    dated = df.withColumn("_month", month).filter("_month is not null")
    counted = measured(dated, ["_month"], score).filter("scored > 0")
    return counted.select(
        F.col("_month").alias("label"),
        round3(F.col("total") / F.col("scored")).alias("value"),
        F.col("scored").alias("count"),
    ).orderBy("label")


def monthly_count(df: DataFrame, date: str = "date_reclamation") -> DataFrame:
    """Rows per month, in month order."""
    if not _has(df, date):
        return _none(df, "label string, value bigint")
    month = ref(date) if "rows" in df.columns else month_key(ts_of(df, date))
    dated = df.select(month.alias("label"), *[c for c in ("rows",) if c in df.columns])
    counted = dated.filter("label is not null").groupBy("label").agg(_rows(dated).alias("value"))
    return counted.orderBy("label")


def score_histogram(df: DataFrame, score: str = presets.SCORE_COLUMN) -> DataFrame:
    """Rows per score rounded half to even, in score order."""
    if not _has(df, score):
        return _none(df, "label int, value bigint")
    bucket = ref(score) if "rows" in df.columns else F.bround(num_of(df, score)).cast("int")
    binned = df.select(bucket.alias("label"), *[c for c in ("rows",) if c in df.columns])
    counted = binned.filter("label is not null").groupBy("label").agg(_rows(binned).alias("value"))
    return counted.orderBy("label")


# --- Scalars ------------------------------------------------------------------------------


def sla_met(column: Column, accepted: Sequence[str] = presets.SLA_TRUE) -> Column:
    """Whether the flag says yes; case-blind, not trimmed, missing is no."""
    return F.coalesce(F.lower(column.cast("string")).isin(*accepted), F.lit(False))


def survey_totals(df: DataFrame, score: str | None = presets.SCORE_COLUMN, product: str = "produit_global") -> DataFrame:
    """One row: responses, valid scores, mean, extremes, share of good scores, products.

    The share is taken over the valid scores only.
    """
    products = F.count_distinct(ref(product)) if product in df.columns else F.lit(0).cast("bigint")
    counted = df.agg(*_measures(df, score), products.alias("products"))
    return counted.select(
        F.coalesce("rows", F.lit(0)).alias("responses"),
        F.coalesce("scored", F.lit(0)).alias("valid_scores"),
        round3(F.try_divide("total", "scored")).alias("mean"),
        round3(F.col("low")).alias("min"),
        round3(F.col("high")).alias("max"),
        round3(F.try_divide("good", "scored") * 100).alias("good_rate_pct"),
        "products",
        round3(F.col("total")).alias("total"),
    )


def distinct_cube(df: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int = DISTINCT_SIZE) -> DataFrame:
    """Per group its rows and a sketch of the distinct values of each column, as ``<column>_sketch``.

    Distinct counts do not add up over groups, but sketches do: stored by country, product and month,
    they give the distinct values of any coarser group without the rows. Missing values do not count.
    """
    sketches = [F.hll_sketch_agg(ref(c).cast("string"), size).alias(f"{c}_sketch") for c in columns]
    return df.groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"), *sketches)


def distinct_error(size: int = DISTINCT_SIZE) -> float:
    """Three standard errors of a merged sketch, as a share of the true count."""
    return 3 * 1.04 / 2 ** (size / 2)


def distinct_estimates(cube: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column by the given keys, from a cube of finer or equal groups."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")).alias(c) for c in columns]
    return cube.groupBy(*[ref(k) for k in keys]).agg(F.sum("rows").alias("rows"), *merged)


def sla_rate(df: DataFrame, column: str = "sla_respecte") -> DataFrame:
    """Claims and the share of all of them whose flag says yes."""
    met = sla_met(ref(column)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("claims"), round3(F.avg(met) * 100).alias("sla_rate_pct"))


def indicators(surveys: DataFrame, claims: DataFrame, claims_selected: bool) -> DataFrame:
    """The indicator table from the two cubes: id, value, hint, availability, in order.

    Claims count as available when their source is selected, even without rows.
    """
    totals = survey_totals(surveys, None, "product")
    any_row = F.col("responses") > 0
    from_surveys = totals.select(
        F.inline(
            F.array(
                _indicator("satisfaction", F.col("mean"), F.col("mean").isNotNull()),
                _indicator("responses", F.col("responses"), any_row),
                _indicator("products", F.col("products"), any_row),
                _indicator("rate", F.col("good_rate_pct"), F.col("good_rate_pct").isNotNull()),
            )
        ),
        "valid_scores",
    )
    counted = claims.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("sla_rows"), F.lit(0)).alias("sla_rows"),
        F.sum("sla_met").alias("met"),
    )
    met = round3(F.try_divide("met", "sla_rows") * 100)
    from_claims = counted.select(
        F.inline(
            F.array(
                _indicator("claims", F.col("rows"), (F.col("rows") > 0) | F.lit(claims_selected)),
                _indicator("sla", met, F.col("sla_rows") > 0),
            )
        ),
        F.lit(None).cast("bigint").alias("valid_scores"),
    ).filter("id <> 'sla' or available")
    hint = (
        F.when(F.col("id") != "satisfaction", F.col("hint"))
        .when(F.col("valid_scores") > 0, F.concat_ws(" ", F.col("valid_scores").cast("string"), "hint"))
        .otherwise("Aucune note")
    )
    both = from_surveys.unionByName(from_claims).withColumn("hint", hint)
    return both.drop("valid_scores").orderBy("position")


def _indicator(name: str, value: Column, available: Column) -> Column:
    position = [i for i, _, _ in presets.INDICATORS].index(name)
    _, label, hint = presets.INDICATORS[position]
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(name).alias("id"),
        F.lit(label).alias("label"),
        value.cast("double").alias("value"),
        F.lit(hint).alias("hint"),
        available.alias("available"),
    )

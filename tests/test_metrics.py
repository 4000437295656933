from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.facts import evidence, extreme_groups, global_statistics, row_join_note, survey_facts, surveys_against_claims
from tallyframe.operators.metrics import (
    claim_cube,
    group_mean,
    indicators,
    monthly_count,
    monthly_mean,
    score_histogram,
    sla_rate,
    survey_cube,
    survey_totals,
    value_counts,
)
from tallyframe.operators.options import column_names, date_extent, filter_values

NAN = float("nan")
D = datetime.datetime


def surveys(spark):
    rows = [
        ("France", "EXPRESS", 2.5, D(2024, 1, 31, 23, 59)), ("France", "STANDARD", 3.5, D(2024, 2, 1)),
        ("Maroc", "EXPRESS", 4.0, D(2024, 2, 2)), ("Maroc", None, 2.0, None), ("Canada", "PREMIUM", NAN, D(2024, 3, 1)),
        (None, "PREMIUM", 5.0, D(2024, 3, 1)), ("Espagne", "EXPRESS", None, D(2024, 4, 1)), ("Italie", "STANDARD", 3.0, D(2024, 2, 5)),
    ]
    return spark.createDataFrame(rows, "pays string, produit_global string, satisfaction_normalisee double, date_enquete timestamp")


def claims(spark):
    rows = [("delai", "France", "Ouverte", "Oui"), ("delai", "Maroc", None, " oui"), ("perte", "Italie", "Ouverte", None), ("casse", "France", "close", "TRUE")]
    df = spark.createDataFrame(rows, "categorie_reclamation string, pays string, statut_reclamation string, sla_respecte string")
    return df.withColumn("date_reclamation", F.lit(D(2024, 5, 6)))


def lines(df):
    return [tuple(r) for r in df.collect()]


def test_means_skip_missing_and_break_ties_by_name(spark):
    expected = [("France", 3.0, 2), ("Italie", 3.0, 1), ("Maroc", 3.0, 2)]
    assert lines(group_mean(surveys(spark), "pays")) == expected
    worst = lines(group_mean(surveys(spark), "produit_global", ascending=True))
    assert worst == [("EXPRESS", 3.25, 2), ("STANDARD", 3.25, 2), ("PREMIUM", 5.0, 1)]


def test_extremes(spark):
    rows = {r.position: (r.label, r.value, r["count"]) for r in extreme_groups(surveys(spark)).collect()}
    assert rows == {"weakest": ("EXPRESS", 3.25, 2), "strongest": ("PREMIUM", 5.0, 1)}
    assert extreme_groups(surveys(spark).filter("false")).count() == 0


def test_histogram_rounds_half_to_even(spark):
    assert lines(score_histogram(surveys(spark))) == [(2, 2), (3, 1), (4, 2), (5, 1)]


def test_monthly(spark):
    assert lines(monthly_mean(surveys(spark))) == [("2024-01", 2.5, 1), ("2024-02", 3.5, 3), ("2024-03", 5.0, 1)]
    assert lines(monthly_count(surveys(spark), "date_enquete")) == [("2024-01", 1), ("2024-02", 3), ("2024-03", 2), ("2024-04", 1)]


def test_totals(spark):
    row = survey_totals(surveys(spark)).first()
    assert (row.responses, row.valid_scores, row.products) == (8, 6, 3)
    assert (row["mean"], row["min"], row["max"]) == (3.333, 2.0, 5.0)
    assert row.good_rate_pct == pytest.approx(33.333)


def test_totals_of_nothing(spark):
    row = survey_totals(surveys(spark).filter("false")).first()
    assert (row.responses, row.valid_scores, row["mean"], row.good_rate_pct, row.products) == (0, 0, None, None, 0)


def test_absent_columns_give_empty_series(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert [f(df, "nope").count() for f in (group_mean, value_counts, monthly_count, score_histogram)] == [0, 0, 0, 0]


def test_value_counts_and_sla(spark):
    assert lines(value_counts(claims(spark), "categorie_reclamation")) == [("delai", 2), ("casse", 1), ("perte", 1)]
    assert lines(value_counts(claims(spark), "categorie_reclamation", 1)) == [("delai", 2)]
    assert lines(sla_rate(claims(spark))) == [(4, 50.0)]


def test_cube_series_equal_direct_series(spark):
    df = surveys(spark)
    cube = survey_cube(df)
    assert lines(group_mean(cube, "country", None)) == lines(group_mean(df, "pays"))
    assert lines(group_mean(cube, "product", None)) == lines(group_mean(df, "produit_global"))
    assert lines(monthly_mean(cube, "month", None)) == lines(monthly_mean(df))
    assert lines(score_histogram(cube, "bucket")) == lines(score_histogram(df))
    assert lines(survey_totals(cube, None, "product")) == lines(survey_totals(df))
    assert lines(value_counts(claim_cube(claims(spark)), "country")) == lines(value_counts(claims(spark), "pays"))
    assert lines(monthly_count(claim_cube(claims(spark)), "month")) == lines(monthly_count(claims(spark)))


def test_indicators(spark):
    both = indicators(survey_cube(surveys(spark)), claim_cube(claims(spark)), True)
    rows = {r.id: r for r in both.collect()}
    assert [r.id for r in both.collect()] == ["satisfaction", "responses", "products", "claims", "rate", "sla"]
    assert rows["satisfaction"].hint == "6 notes valides" and rows["sla"].value == 50.0
    nothing = claims(spark).filter("false")
    rows = {r.id: r for r in indicators(survey_cube(surveys(spark).filter("false")), claim_cube(nothing), False).collect()}
    assert "sla" not in rows and not any(r.available for r in rows.values())
    assert rows["satisfaction"].hint == "Aucune note"
    selected = {r.id: r for r in indicators(survey_cube(surveys(spark)), claim_cube(nothing), True).collect()}
    assert selected["claims"].available and selected["claims"].value == 0
    without_flag = claims(spark).drop("sla_respecte")
    assert "sla" not in {r.id for r in indicators(survey_cube(surveys(spark)), claim_cube(without_flag), True).collect()}


def test_aggregates_side_by_side(spark):
    rows = {r.group: (r["mean"], r.claims) for r in surveys_against_claims(surveys(spark), claims(spark)).collect()}
    assert rows == {"France": (3.0, 2), "Italie": (3.0, 1), "Maroc": (3.0, 1)}
    assert row_join_note()["row_join_possible"] is False and "clé commune" in row_join_note()["reason"]


def test_survey_facts_and_statistics(spark):
    facts = survey_facts(surveys(spark))
    assert lines(facts["by_product"])[0][0] == "EXPRESS" and facts["totals"].first().valid_scores == 6
    stats = global_statistics(surveys(spark))
    assert stats["totals"].first().total == 20.0
    assert lines(stats["by_country"])[0] == ("France", 2, 6.0, 3.0)
    lacking = global_statistics(claims(spark))["totals"].first()
    assert lacking.responses == 4 and lacking.unavailable == "produit_global, satisfaction_normalisee"


def test_options(spark):
    rows = spark.createDataFrame([(" France ", 1.0, "NaN"), ("France", None, "none"), ("", 2.0, "x"), (None, 1.0, " ")], "pays string, code_produit double, fragile string")
    found = lines(filter_values({"a": rows, "b": surveys(spark).select("pays")}))
    assert [v for f, v in found if f == "pays"] == ["Canada", "Espagne", "France", "Italie", "Maroc"]
    assert [v for f, v in found if f == "code_produit"] == ["1.0", "2.0"]
    assert [v for f, v in found if f == "fragile"] == ["x"]
    assert lines(date_extent({"s": surveys(spark), "c": claims(spark)})) == [("2024-01-31", "2024-05-06")]
    assert lines(date_extent({"a": rows})) == [(None, None)]
    assert column_names({"a": rows, "b": spark.createDataFrame([(1, 2)], "_h int, z int")}) == ["code_produit", "fragile", "pays", "z"]


def test_evidence(spark):
    frames = {
        "a": spark.createDataFrame([(i, f"v{i}", None) for i in range(50)], "k int, v string, n string").withColumn("_h", F.lit(1)),
        "b": spark.createDataFrame([(i, "w") for i in range(50, 60)], "k int, v string"),
        "c": spark.createDataFrame([], "k int"),
    }
    found = evidence(frames, {s: "k" for s in frames}, limit=5).collect()
    assert [r.record for r in found] == [
        '{"k":0,"v":"v0","_source":"a"}', '{"k":50,"v":"w","_source":"b"}',
    ]
    assert len(evidence(frames, {s: "k" for s in frames}, limit=2).collect()) == 2

from __future__ import annotations

import datetime

import pytest

from tallyframe.operators.filters import FilterSpec, apply_filters, apply_to_all, check_pattern


def surveys(spark):
    d = datetime.datetime
    rows = [
        (1, " France ", 5.0, d(2024, 1, 1), True),
        (2, "FRANCE", float("nan"), d(2024, 1, 31, 23, 59, 59), False),
        (3, "Maroc", 3.0, d(2024, 1, 31, 23, 59, 59, 500000), None),
        (4, None, None, None, True),
        (5, "Canada", 1e7, d(2024, 2, 1), True),
    ]
    return spark.createDataFrame(rows, "id int, pays string, satisfaction_normalisee double, date_enquete timestamp, fragile boolean")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.mark.parametrize(
    "spec, expected",
    [
        (FilterSpec(), [1, 2, 3, 4, 5]),
        (FilterSpec(values={"pays": ["france "]}), [1, 2]),
        (FilterSpec(values={"pays": []}), [1, 2, 3, 4, 5]),
        (FilterSpec(values={"pays": ["maroc"]}, chart_values=["CANADA"]), [3, 5]),
        (FilterSpec(chart_values=["canada"]), [5]),
        (FilterSpec(values={"fragile": ["true"]}), [1, 4, 5]),
        (FilterSpec(values={"satisfaction_normalisee": ["10000000.0"]}), [5]),
        (FilterSpec(values={"absent": ["x"]}), [1, 2, 3, 4, 5]),
        (FilterSpec(score_min=3), [1, 3, 5]),
        (FilterSpec(score_min=3, score_max=5), [1, 3]),
        (FilterSpec(score_max=3), [3]),
        (FilterSpec(date_end="2024-01-31"), [1, 2]),
        (FilterSpec(date_start="2024-01-31"), [2, 3, 5]),
        (FilterSpec(date_start="soon"), []),
        (FilterSpec(date_end="soon"), []),
        (FilterSpec(search="NaT"), [4]),
        (FilterSpec(search="none"), []),
        (FilterSpec(search="nan"), [2, 3, 4]),
        (FilterSpec(search=r"5 CANADA \D+\.0"), [5]),
        (FilterSpec(search="(fran", search_literal=True), []),
        (FilterSpec(search="^maroc$", search_columns=["pays", "absent"]), [3]),
    ],
)
def test_filters(spark, spec, expected):
    kept = apply_filters(surveys(spark), spec)
    assert ids(kept) == expected
    assert ids(apply_filters(kept, spec)) == expected


def test_a_source_without_the_column_keeps_its_rows(spark):
    claims = spark.createDataFrame([(1, "web")], "id int, canal_reclamation string")
    made = apply_to_all({"s": surveys(spark), "c": claims}, FilterSpec(score_min=5, values={"canal_reclamation": ["phone"]}))
    assert ids(made["s"]) == [1, 5] and ids(made["c"]) == []


def test_hidden_columns_are_searched(spark):
    df = spark.createDataFrame([(1, "satisfaction")], "id int, _kind string")
    assert ids(apply_filters(df, FilterSpec(search="satisfaction"))) == [1]


def test_bad_pattern(spark):
    with pytest.raises(ValueError, match="malformed"):
        check_pattern("(")
    with pytest.raises(Exception):
        apply_filters(surveys(spark), FilterSpec(search="(")).collect()


def test_typed_filters_reach_the_parquet_scan(spark, sf):
    spec = FilterSpec(score_min=3, score_column="o_totalprice", date_columns=("o_orderdate",), date_start="1996-01-01")
    df = apply_filters(spark.read.parquet(f"{sf}/orders.parquet"), spec).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,3.0)" in plan.split("PushedFilters")[1]
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]

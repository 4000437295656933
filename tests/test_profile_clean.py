from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators.clean import (
    cap_outliers,
    category_stats,
    correct_all,
    correction_log,
    drop_weak,
    fill_categories,
    imputation_log,
    imputation_stats,
    impute_all,
    impute_numeric,
    weak_columns,
)
from tallyframe.operators.profile import (
    compare_missing,
    correlations,
    duplicate_rows,
    find_target,
    low_correlation_candidates,
    missing_report,
    outlier_report,
    profile,
    top_missing,
)

NAN = float("nan")


def one(spark, rows, schema):
    return spark.createDataFrame([("s", *r) for r in rows], "source string, " + schema)


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_find_target():
    assert find_target(["A", " Overall-Satisfaction "]) == " Overall-Satisfaction "
    assert find_target(["satisfaction", "Rating"]) == "Rating"
    assert find_target(["global/satisfaction"]) == "global/satisfaction"
    assert find_target(["Rating", "rating"]) == "rating"
    assert find_target(["gesamtzufriedenheit"]) is None


def test_missing_counts_null_and_nan(spark):
    df = one(spark, [(1.0, "a", None), (NAN, None, None), (None, "b", None)], "x double, t string, e int")
    found = by_column(missing_report(df, ["source"]))
    assert {c: r["missing_count"] for c, r in found.items()} == {"x": 2, "t": 1, "e": 3}
    assert found["x"]["missing_rate_pct"] == 66.67 and found["e"]["dtype"] == "int"


def test_duplicates_treat_missing_as_equal(spark):
    df = one(spark, [(None, NAN), (None, None), (1, 2.0), (1, 2.0), (1, 2.0)], "a int, b double")
    assert duplicate_rows(df, ["source"]).first().duplicate_rows == 3


def test_profile_of_unlike_tables(spark):
    a = spark.createDataFrame([(1, None, True)], "n int, rating double, b boolean")
    b = spark.createDataFrame([("x",), ("x",)], "t string")
    rows = {r.source: r.asDict() for r in profile({"a": a, "b": b}).collect()}
    assert rows["a"]["numeric_columns"] == 2 and rows["a"]["categorical_columns"] == 1
    assert rows["a"]["target_column"] == "rating" and rows["b"]["target_column"] is None
    assert rows["a"]["missing_rate_global_pct"] == 33.33 and rows["b"]["duplicate_rows"] == 1


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(a), float(a + b), 5.0, float(b) if i % 9 else NAN, None if i else 1.0) for i, (a, b) in enumerate(zip(x, y))]
    df = one(spark, rows, "x double, rating double, constant double, gaps double, single double")
    found = {r.variable: r for r in correlations(df, ["source"]).collect()}
    assert found["x"].pearson_r == pytest.approx(np.corrcoef(x, x + y)[0, 1])
    keep = np.array([bool(i % 9) for i in range(200)])
    assert found["gaps"].pearson_r == pytest.approx(np.corrcoef(y[keep], (x + y)[keep])[0, 1])
    assert found["gaps"].n_valid == keep.sum()
    assert found["constant"].pearson_r is None and found["constant"].n_valid == 200
    assert found["single"].pearson_r is None and found["single"].n_valid == 1


def test_no_numeric_score_no_correlations(spark):
    text = spark.createDataFrame([("5", 1.0)], "rating string, x double")
    none = spark.createDataFrame([(1.0,)], "x double")
    assert correlations({"text": text, "none": none}).count() == 0


def test_pruning_keeps_protected_and_undefined(spark):
    rows = [(float(i), float(i % 2), 1.0, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "rating double, weak double, constant double, poids_kg double")
    found = correlations({"s": df})
    weak = weak_columns(found)
    assert [r.variable for r in weak.collect()] == ["weak"]
    assert drop_weak({"s": df}, weak)["s"].columns == ["rating", "constant", "poids_kg"]
    assert [r.variable for r in low_correlation_candidates(found).collect()] == ["poids_kg", "weak"]


def gap_table(spark):
    # 5 of 100 missing is not above the limit, 6 of 100 is.
    rows = [(None if i < 5 else float(i), None if i < 6 else float(i * i), None, i) for i in range(100)]
    return one(spark, rows, "five double, six double, empty double, whole int")


def test_imputation_branches(spark):
    df = gap_table(spark)
    log = by_column(imputation_log(imputation_stats(df, ["source"])))
    assert {c: r["method"] for c, r in log.items()} == {"five": "mean", "six": "median", "empty": "median", "whole": "no_missing"}
    assert log["five"]["imputation_value"] == np.mean(range(5, 100))
    assert log["six"]["imputation_value"] == np.median([i * i for i in range(6, 100)])
    assert log["empty"]["imputation_value"] is None and log["empty"]["missing_after"] == 100
    assert log["five"]["missing_after"] == 0 and log["whole"]["missing_before"] == 0


def test_after_imputation_only_empty_columns_miss(spark):
    df = gap_table(spark)
    filled = impute_numeric(df, imputation_stats(df, ["source"]), ["source"])
    left = by_column(missing_report(filled, ["source"]))
    assert {c: r["missing_count"] for c, r in left.items()} == {"five": 0, "six": 0, "empty": 100, "whole": 0}
    row = compare_missing(df, filled, ["source"]).first()
    assert (row.missing_before, row.missing_after, row.missing_removed) == (111, 100, 11)


def test_imputing_unlike_tables_leaves_full_integers(spark):
    tables = {"a": gap_table(spark).drop("source"), "b": spark.createDataFrame([(1,), (None,), (4,)], "n int")}
    filled, log = impute_all(tables)
    assert dict(filled["a"].dtypes)["whole"] == "int"
    assert sorted(r[0] for r in filled["b"].collect()) == [1.0, 2.5, 4.0]
    assert log.filter("source = 'b'").first().method == "median"


def test_mode_ties_and_default(spark):
    rows = [("b", None, "x"), ("a", None, "x"), (None, None, "y"), ("a", None, "y"), ("b", None, "y")]
    df = one(spark, rows, "tie string, empty string, full string")
    stats = by_column(category_stats(df, ["source"]))
    assert {c: (r["missing_count"], r["replacement"]) for c, r in stats.items()} == {"tie": (1, "a"), "empty": (5, "Non renseigne")}
    filled = fill_categories(df, category_stats(df, ["source"]), ["source"])
    assert filled.filter("tie is null or empty is null").count() == 0
    assert [r.full for r in filled.collect()] == ["x", "x", "y", "y", "y"]


def test_capping_by_source(spark):
    rows = [("p", float(v)) for v in [1, 2, 3, 4, 100]] + [("q", float(v)) for v in [100, 101, 102, 103, -50]] + [("p", None)]
    df = spark.createDataFrame(rows, "source string, v double")
    bounds = outlier_report(df, ["source"])
    found = {r.source: r for r in bounds.collect()}
    assert (found["p"].valid_count, found["p"].outlier_count, found["p"].upper_bound) == (5, 1, 7.0)
    capped = cap_outliers(df, bounds, ["source"])
    values = {s: sorted((r.v for r in capped.collect() if r.source == s), key=lambda v: (v is None, v)) for s in "pq"}
    assert values["p"] == [1.0, 2.0, 3.0, 4.0, 7.0, None]
    assert values["q"] == [found["q"].lower_bound, 100.0, 101.0, 102.0, 103.0]
    outside = capped.join(bounds, "source").filter((F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound")))
    assert outside.count() == 0


def test_empty_column_has_no_outlier_row(spark):
    df = one(spark, [(None, 1.0), (None, 2.0)], "e double, v double")
    assert [r["column"] for r in outlier_report(df, ["source"]).collect()] == ["v"]


def test_correcting_unlike_tables_and_log(spark):
    tables = {
        "a": spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y"), (100, "x")], "n int, t string"),
        "b": spark.createDataFrame([(1,), (2,), (3,)], "whole int"),
    }
    bounds = outlier_report(tables)
    fixed, log = correct_all(tables, bounds)
    assert [r.n for r in fixed["a"].orderBy("n").collect()][-1] == 7.0
    assert dict(fixed["b"].dtypes)["whole"] == "int"
    rows = {(r.source, r.column): r for r in log.collect()}
    assert rows["a", "t"].value == "x" and rows["a", "n"].value == "[-1.0, 7.0]" and len(rows) == 2
    assert correction_log(category_stats(tables), bounds, ["source"]).count() == 2


def test_top_missing(spark):
    names = [f"c{i:02d}" for i in range(15)]
    rows = [tuple(None if i >= j else 1 for i in range(15)) for j in range(15)]
    df = one(spark, rows, ", ".join(f"{n} int" for n in names))
    top = top_missing(missing_report(df, ["source"]), ["source"]).collect()
    assert sorted(r["column"] for r in top) == names[3:]


def test_one_table_without_a_source_key(spark):
    from tallyframe.operators.profile import compare_missing, missing_report, profile, structure_report

    one = spark.createDataFrame([(1, None), (2, "a"), (2, "a")], "x long, y string")
    got = profile(one).collect()
    assert len(got) == 1 and (got[0]["rows"], got[0]["duplicate_rows"], got[0]["total_missing"]) == (3, 1, 1)
    assert structure_report(one).count() == 1
    assert compare_missing(one, one.na.fill("-")).first()["missing_removed"] == 1
    empty = one.limit(0)
    assert {r["missing_rate_pct"] for r in missing_report(empty).collect()} == {None}
    plan = compare_missing(one, one)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_single_table_without_source_key(spark):
    from tallyframe.operators.clean import cap_outliers, category_stats, fill_categories, imputation_stats, impute_numeric
    from tallyframe.operators.profile import compare_missing, missing_report, outlier_report, profile, structure_report

    rows = [(1.0, "a"), (2.0, "a"), (3.0, None), (None, "b"), (900.0, "a")]
    df = spark.createDataFrame(rows, "n double, t string")
    empty = df.limit(0)
    assert profile(df).count() == profile(empty).count() and structure_report(df).count() == 1
    assert missing_report(empty).count() == 2 and structure_report(empty).count() == 1
    filled = fill_categories(df, category_stats(df), ())
    imputed = impute_numeric(filled, imputation_stats(df), ())
    assert imputed.filter("n is null or t is null").count() == 0
    assert compare_missing(df, imputed).first().missing_removed == 2
    capped = cap_outliers(imputed, outlier_report(imputed), ())
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert capped.agg({"n": "max"}).first()[0] < 900
    assert impute_numeric(empty, imputation_stats(empty), ()).count() == 0


def test_empty_source_keeps_its_rows_in_reports(spark):
    from tallyframe.operators.profile import missing_report, profile, structure_report

    df = spark.createDataFrame([(1.0, "a")], "n double, t string")
    tables = {"full": df, "empty": df.limit(0)}
    assert {r.source for r in structure_report(tables).collect()} == {"full", "empty"}
    line = profile(tables).filter("source = 'empty'").first()
    assert (line.rows, line.total_missing, line.duplicate_rows) == (0, 0, 0)
    assert {r.source for r in missing_report(tables).collect()} == {"full", "empty"}

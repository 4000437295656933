from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import moments as module
from tallyframe.operators.clean import correct_all, impute_all
from tallyframe.operators.moments import Fitted, exact_ranks, filled_at, merge_moments, moments
from tallyframe.operators.profile import correlations, duplicate_rows, missing_report, outlier_report, structure_report
from tallyframe.plans.fitting import fenced_outliers, fit_cleaning
from tallyframe.plans.wrangle import wrangle
from workload.views import raw_sources


def rows_of(df, digits=9):
    plain = lambda v: float(f"{v:.{digits}g}") if isinstance(v, float) else v
    return sorted((tuple((c, plain(r[c])) for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def frames(spark):
    made = random.Random(4)
    number = lambda gap: None if made.random() < gap else made.choice([made.gauss(0, 5), 7.0, 7.0, -1e9 * made.random()])
    rows = [
        (i, number(0.3), number(0.02), float(i % 5) if i % 7 else float("nan"), None, made.choice(["x", "y", "y", None]), "full", 2)
        for i in range(900)
    ]
    a = spark.createDataFrame(rows, "id long, wide double, thin double, satisfaction double, none double, word string, full string, two int")
    return {"a": a.repartition(3), "b": a.filter("id < 40").select("id", "thin", "word"), "empty": a.limit(0)}


def test_reports_equal_those_of_their_own_passes(frames):
    fitted = Fitted.of(frames)
    assert rows_of(fitted.missing_report()) == rows_of(missing_report(frames))
    assert rows_of(fitted.correlations()) == rows_of(correlations(frames))
    described = fitted.profile().join(duplicate_rows(frames), "source")
    assert rows_of(described) == rows_of(structure_report(frames))
    assert rows_of(fenced_outliers(frames, fitted)) == rows_of(outlier_report(frames))
    assert fitted.rows() == {"a": 900, "b": 40, "empty": 0}


def test_cleaning_equals_the_steps_one_by_one(frames):
    cleaned = fit_cleaning(frames, Fitted.of(frames))
    imputed, log = impute_all(frames)
    bounds = outlier_report(imputed)
    corrected, corrections = correct_all(imputed, bounds)
    assert rows_of(cleaned.imputation) == rows_of(log)
    assert rows_of(cleaned.outliers, 6) == rows_of(bounds, 6)
    assert [r for r in rows_of(cleaned.corrections) if ("method", "mode") in r] == [r for r in rows_of(corrections) if ("method", "mode") in r]
    for source in frames:
        assert rows_of(cleaned.corrected[source], 6) == rows_of(corrected[source], 6)


def test_parts_merge_to_the_whole(frames):
    table = frames["a"].withColumn("source", F.when(F.col("id") % 3 == 0, "p").otherwise("q"))
    parts = [moments(table.filter(F.col("id") % 4 == i), ["source"]) for i in range(4)] + [moments(table.limit(0), ["source"])]
    merged = merge_moments(parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4]))
    whole = moments(table, ["source"])
    names = [c for c in whole.columns if c != "sketch"]
    for got, want in zip(rows_of(merged.select(names)), rows_of(whole.select(names))):
        for (name, x), (_, y) in zip(got, want):
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6), (name, x, y)


@pytest.mark.parametrize("error", [None, 1e-9])
def test_exact_ranks(frames, monkeypatch, error):
    """Every rank is exact, also where the sketch claims to be better than it is."""
    if error:
        monkeypatch.setattr(module, "SKETCH_SIZE", 8)
        monkeypatch.setattr(module, "rank_error", lambda size=8: error)
    fitted = Fitted.of(frames)
    values = sorted(r[0] for r in frames["a"].select("wide").dropna().collect())
    wanted = [0, 1, len(values) // 3, len(values) - 1, len(values) + 5, -2]
    found = exact_ranks(frames, fitted, {("a", "wide"): wanted, ("a", "none"): [0], ("b", "id"): [39], ("empty", "id"): [0]})
    assert found[("a", "wide")] == {r: values[r] for r in wanted if 0 <= r < len(values)}
    assert found[("b", "id")] == {39: 39.0} and found[("a", "none")] == found[("empty", "id")] == {}


def test_ranks_after_filling():
    made = random.Random(2)
    for _ in range(200):
        values = sorted(made.randrange(9) for _ in range(made.randrange(1, 12)))
        gaps, fill = made.randrange(5), made.choice([*values, 3.5, -1, 99])
        whole = sorted([*values, *[fill] * gaps])
        at = dict(enumerate(values))
        assert [filled_at(at, r, gaps, fill) for r in range(len(whole))] == whole


def test_wrangling_reads_the_raw_rows_four_times(spark, sf):
    passed = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for batch in batches:
                passed.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    raw = raw_sources(spark, sf)
    total = sum(df.count() for df in raw.values())
    wrangle({source: counted(df) for source, df in raw.items()})
    assert passed.value <= 4 * total


def test_digests_only_point_at_duplicates(spark):
    rows = [(1, 0.0, "x"), (1, -0.0, "x"), (1, None, None), (1, None, None), (1, None, None), (2, float("nan"), "y"), (2, None, "y"), (3, 1.0, "z")]
    df = spark.createDataFrame(rows, "k int, v double, t string")
    assert duplicate_rows(df).first()["duplicate_rows"] == 4
    assert {r["k"]: r["duplicate_rows"] for r in duplicate_rows(df, ["k"]).collect()} == {1: 3, 2: 1, 3: 0}
    assert duplicate_rows({"all": df, "none": df.limit(0)}).collect() == [("all", 4), ("none", 0)]


def test_a_constant_column_has_no_correlation(spark):
    """Merged moments of a constant keep a trace of rounding, which is no spread."""
    rows = spark.range(60_000).select(
        F.lit("s").alias("source"), "id", F.lit(0.1).alias("constant"), (F.col("id") % 977 * 1.3).alias("other"),
        F.when(F.col("id") % 4 > 0, F.col("id") * 0.7).alias("satisfaction"),
        # Constant only where the score is present.
        F.when(F.col("id") % 4 > 0, F.lit(0.3)).otherwise(F.col("id") * 1.0).alias("there"),
    ).repartition(7)
    parts = [moments(rows.filter(F.col("id") % 3 == i).drop("id"), ["source"]) for i in range(3)]
    merged = Fitted(merge_moments(parts[0].union(parts[1]).union(parts[2])), ("source",)).correlations()
    for found in (merged, Fitted(moments(rows.drop("id"), ["source"]), ("source",)).correlations(), correlations(rows.drop("id"), ["source"])):
        r = {line["variable"]: line["pearson_r"] for line in found.collect()}
        assert r["constant"] is None and r["there"] is None and abs(r["other"]) < 0.1, r

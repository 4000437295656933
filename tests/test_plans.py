"""The composed plans: acceptance scenarios, invariants, and the shape of key plans."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyframe import presets
from tallyframe.operators.filters import FilterSpec, apply_filters
from tallyframe.operators.products import add_product, preset_lookup
from tallyframe.operators.profile import missing_report, outlier_report
from tallyframe.operators.schema import standardize
from tallyframe.plans.ask import answer_questions, check_questions, question_facts
from tallyframe.plans.dashboard import combined_table, dashboard, export, options, table_page
from tallyframe.plans.quality import normalized_profiles, quality, quality_of_files
from tallyframe.plans.wrangle import wrangle
from tallyframe.session import scratch_path
from tallyframe.sources.readers import SourceSet
from workload.sets import catalog, source_set
from workload.views import raw_sources


@pytest.fixture(scope="module")
def sources(spark, sf):
    return source_set(spark, sf)


@pytest.fixture(scope="module")
def done(spark, sf):
    return wrangle(raw_sources(spark, sf))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def labels(df):
    return {r.label for r in df.collect()}


# --- Acceptance ---------------------------------------------------------------------------


def test_one_source(sources):
    made = dashboard(sources, ["france"])
    assert labels(made["satisfaction_by_country"]) == {"France"}
    counts = {r.id: r.rows for r in made["row_counts"].collect()}
    assert counts == {"satisfaction_rows": sources.frames["france"].count(), "claims_rows": 0}
    rows = {r.id: r for r in made["indicators"].collect()}
    assert not rows["claims"].available and "sla" not in rows


def test_two_sources(sources):
    made = dashboard(sources, ["france", "espagne"])
    total = sources.frames["france"].count() + sources.frames["espagne"].count()
    assert {r.id: r.rows for r in made["row_counts"].collect()}["satisfaction_rows"] == total
    assert labels(made["satisfaction_by_country"]) == {"France", "Espagne"}


def test_claims_only(sources):
    made = dashboard(sources, ["reclamations"])
    assert {r.id: r.rows for r in made["row_counts"].collect()} == {
        "claims_rows": sources.frames["reclamations"].count(), "satisfaction_rows": 0,
    }
    overview = made["overview"].first()
    assert overview.row_count > 0 and overview.has_claims and not overview.has_satisfaction
    assert made["satisfaction_by_country"].count() == 0 and made["claims_by_category"].count() == 5


def test_filter_agrees_with_indicator(sources):
    spec = FilterSpec(score_max=3)
    made = dashboard(sources, ["france"], spec)
    kept = apply_filters(sources.frames["france"], spec).count()
    assert {r.id: r.value for r in made["indicators"].collect()}["responses"] == kept > 0


def test_options_ignore_filters(sources):
    values, dates, names = options(sources, ["france", "reclamations"])
    assert {r.value for r in values.filter("field = 'pays'").collect()} >= {"France", "Italie"}
    assert dates.first().date_max.startswith("2024-01-") and "_kind" not in names
    with pytest.raises(ValueError, match="inconnues"):
        options(sources, ["nope"])


def test_answers(spark, sources):
    rows = [
        (1, "Compare la France et le Maroc.", ["france"]), (2, "Quelle est la satisfaction moyenne ?", ["espagne"]),
        (3, "Quelles sont les principales réclamations ?", ["reclamations"]), (4, "Compare la France et le Maroc.", ["france"]),
        (5, "the and ?", []),
    ]
    asked = spark.createDataFrame(rows, "question_id int, question string, selected array<string>")
    found = {r.question_id: r for r in answer_questions(asked, sources, k=3).collect()}
    assert found[1].conflict and found[1].effective == ["france", "maroc"] and "Avertissement" in found[1].summary
    assert not found[2].conflict and found[2].mean is not None and [x.source for x in found[2].retrieved] == ["espagne"] * 3
    assert found[3].responses == 0 and found[3].claims == sources.frames["reclamations"].count()
    assert {x.source for x in found[3].retrieved} == {"reclamations"}
    assert found[1].context == found[4].context
    assert found[5].retrieved is None and found[5].responses > 0
    assert [x.source for x in found[1].evidence] == ["france"] * 4 + ["maroc"] * 4 and found[1].missing == []
    assert [x.rank for x in found[2].evidence] == list(range(1, 9))
    assert found[1].row_count == sum(sources.frames[s].count() for s in ("france", "maroc"))
    context = json.loads(found[1].context)
    assert context["sources"] == ["France", "Maroc"] and len(context["rows"]) == 3
    assert "Aucune clé commune" in context["link"]
    assert [c["label"] for c in context["facts"]["by_country"]] == [r["label"] for r in found[1].by_country]


def test_facts_without_retrieval_and_messages_of_missing_sources(spark, sources):
    frames = {s: df for s, df in sources.frames.items() if s != "maroc"}
    few = SourceSet.of(catalog(), frames)
    asked = spark.createDataFrame([(1, "Compare la France et le Maroc.", ["france"])], "question_id int, question string, selected array<string>")
    facts = question_facts(asked, few)
    assert "retrieved" not in facts.columns
    row, whole = facts.first(), answer_questions(asked, few).first()
    assert row.missing == [few.errors["maroc"]] == whole.missing
    assert row.summary == whole.summary and row.row_count == whole.row_count == frames["france"].count()
    assert [x.source for x in whole.evidence] == ["france"] * 8


def test_answer_over_nothing(spark, sources):
    asked = spark.createDataFrame([(1, "Bonjour tout le monde", ["france"])], "question_id int, question string, selected array<string>")
    row = answer_questions(asked, sources, FilterSpec(values={"pays": ["Atlantide"]})).first()
    assert row.responses == 0 and row.summary.endswith("Aucune statistique calculable sur le périmètre sélectionné.")


def test_blank_questions_are_named(spark):
    asked = spark.createDataFrame([(1, "  "), (2, "x")], "question_id int, question string")
    with pytest.raises(ValueError, match="vide"):
        check_questions(asked, columns=["question_id"])


def test_table_pages_and_export(sources):
    ids = ["reclamations", "maroc"]
    first = table_page(sources, ids, size=7)
    assert first.rows.columns[:2] == ["_source_label", "_kind"] and len(first.rows.collect()) == 7
    assert {r._kind for r in first.rows.collect()} == {"reclamations"}
    assert first.total == combined_table(sources, ids).count()
    out = export(sources, ids, scratch_path(first.rows.sparkSession, "export"), fmt="parquet")
    assert first.rows.sparkSession.read.parquet(out).count() == first.total


# --- Wrangling -----------------------------------------------------------------------------


def test_wrangled_rows(done, sf, spark):
    rows_in = sum(df.count() for df in done.raw.values())
    assert done.consolidated.count() == rows_in
    assert done.consolidated.filter("produit_global is null or id_unique is null").count() == 0
    assert done.consolidated.select("id_unique").distinct().count() == rows_in
    assert done.consolidated.filter(~F.col("satisfaction_normalisee").between(1, 5)).count() == 0
    assert done.tables["Maroc"].columns == list(presets.FINAL_COLUMNS)


def test_only_branches_with_a_numeric_score_are_pruned(done):
    assert {r.source for r in done.logs["correlations"].collect()} == {"France", "Canada"}
    removed = done.logs["removed_columns"].collect()
    assert removed and not {r.variable for r in removed} & set(presets.PROTECTED_COLUMNS)


def test_missing_comments_take_the_most_frequent(done):
    assert done.tables["Maroc"].filter("commentaire_global is null or satisfaction_normalisee is null").count() == 0


def test_reports(done):
    assert done.structure().count() == 5
    assert done.missing().count() == 66
    compared = {r.source: r for r in done.missing_comparison().collect()}
    assert all(r.missing_removed > 0 for r in compared.values())
    left = missing_report(done.imputed).filter("dtype = 'double' and missing_count > 0")
    assert left.count() == 0


def test_large_groups_take_counting_passes_to_the_same_bounds(done):
    small = {(r.source, r.column): tuple(r)[2:] for r in outlier_report({"France": done.imputed["France"]}).collect()}
    large = {
        (r.source, r.column): tuple(r)[2:]
        for r in outlier_report({"France": done.imputed["France"]}, direct_values=50).collect()
    }
    assert small.keys() == large.keys()
    for key, row in small.items():
        assert row == pytest.approx(large[key], rel=1e-12)


def test_quality(sources, sf, spark):
    reports = quality(raw_sources(spark, sf), sources)
    assert reports["normalized"].count() == 6 and reports["correlations"].count() == 12
    ordered = [r.abs_r for r in reports["correlations"].collect() if r.abs_r is not None]
    assert ordered == sorted(ordered, reverse=True)


def test_unreadable_raw_files_leave_the_normalized_reports(spark, sources, tmp_path):
    raw_sources_path = str(tmp_path / "a.parquet")
    spark.range(5).selectExpr("id", "id * 2.0D AS note").write.parquet(raw_sources_path)
    found = quality_of_files(spark, {"a": raw_sources_path})
    assert found["status"].first().raw_available and found["structure"].first().rows == 5
    gone = quality_of_files(spark, {"a": raw_sources_path, "b": str(tmp_path / "gone.parquet")}, sources)
    status = gone["status"].first()
    assert not status.raw_available and "gone.parquet" in status.error
    for name in ("structure", "missing", "correlations", "outliers"):
        assert gone[name].columns == found[name].columns and gone[name].isEmpty()
    assert gone["normalized"].count() == 6


def test_unreadable_sources_keep_a_row(sources):
    from tallyframe.sources.readers import SourceSet

    partial = SourceSet(sources.specs, {"france": sources.frames["france"]}, {"canada": "gone"})
    rows = {r.id: r for r in normalized_profiles(partial)[0].collect()}
    assert len(rows) == 6 and rows["canada"].error == "gone" and rows["france"].rows > 0


# --- Plans ----------------------------------------------------------------------------------


def test_product_lookup_does_not_move_the_rows(spark, sf):
    raw = raw_sources(spark, sf)["France"]
    plan = plan_of(add_product(standardize("France", raw), preset_lookup(spark)))
    assert "Exchange hashpartitioning(pays" not in plan and "Exchange hashpartitioning(code_produit" not in plan
    assert "Scan ExistingRDD[pays" in plan.split("BroadcastExchange")[-1]


def test_series_read_only_their_columns(sources, spark, sf):
    from tallyframe.operators.metrics import group_mean
    from workload.sets import survey_rows

    plan = plan_of(group_mean(survey_rows(spark, sf), "pays"))
    assert "ReadSchema: struct<pays:string,satisfaction_normalisee:double>" in plan
    assert plan.count("FileScan") == 1


def test_dashboard_series_read_the_cube_not_the_rows(sources):
    made = dashboard(sources, ["france", "reclamations"])
    for name in ("satisfaction_by_country", "claims_by_status", "indicators"):
        assert "-cube-" in plan_of(made[name])


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    from workload import QUERIES

    plan = plan_of(QUERIES["retrieve_many"](spark, sf))
    # The plan is printed from the last step down.
    final = plan.index("row_number(), 8, Final")
    partial = plan.index("row_number(), 8, Partial", final)
    assert "Exchange hashpartitioning(unit" in plan[final:partial]
    assert "Exchange hashpartitioning(unit#" in plan and "MapInPandas" not in plan


def test_service_filters_reach_the_scan(sources):
    from tallyframe.operators.filters import apply_filters

    spec = FilterSpec(score_min=3, score_max=4, date_start="1996-01-01", date_end="1997-01-01")
    plan = plan_of(apply_filters(sources.frames["france"], spec).select("id_unique"))
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    for part in ("GreaterThanOrEqual(satisfaction_normalisee,3.0)", "LessThanOrEqual(satisfaction_normalisee,4.0)", "GreaterThanOrEqual(date_enquete,"):
        assert part in pushed
    assert "struct<id_unique:string,date_enquete:timestamp,satisfaction_normalisee:double>" in plan


def test_nothing_is_published_before_the_guards(spark, sf, tmp_path):
    raw = dict(raw_sources(spark, sf))
    raw["Allemagne"] = raw["Allemagne"].withColumn("produkt_code", F.lit("PAK_999"))
    raw["Canada"] = raw["Canada"].withColumn("product_code", F.lit("PARCEL_ODD"))
    out = tmp_path / "out"
    with pytest.raises(ValueError, match="PA[RK].*PA[RK]"):
        wrangle(raw, out=str(out))
    assert not out.exists()


def test_published_table_equals_the_result(spark, sf, tmp_path):
    out = tmp_path / "out"
    done = wrangle(raw_sources(spark, sf), out=str(out))
    published = spark.read.parquet(str(out / "normalized"))
    assert published.count() == done.consolidated.count() > 0
    assert (out / "product_reference" / "_SUCCESS").exists()


@pytest.mark.parametrize(
    "name", ["imputation_log", "cap_outliers", "correction_log", "outlier_report", "compare_missing", "impute_numeric"]
)
def test_a_table_read_often_is_joined_once(spark, sf, monkeypatch, name):
    """Customers are neither broadcast nor joined again by each pass over the rows."""
    from workload import QUERIES, views

    joins, store = [], getattr(views, "materialize", None)

    def stored(df, *args):
        joins.append(plan_of(df))
        return store(df, *args)

    monkeypatch.setattr(views, "materialize", stored, raising=False)
    last = plan_of(QUERIES[name](spark, sf))
    assert "customer.parquet" not in last
    assert len(joins) == 1 and "customer.parquet" in joins[0] and "SortMergeJoin" in joins[0] and "Broadcast" not in joins[0]


def test_evidence_needs_no_retrieval(spark, sources, monkeypatch):
    """The evidence of a question is the same whether or not rows are retrieved for it."""
    from tallyframe.plans import ask

    asked = spark.createDataFrame(
        [(1, "colis en France", ["france"]), (2, "colis", ["maroc", "reclamations"])], "question_id int, question string, selected array<string>"
    )
    names = ("question_id", "row_count", "summary", "missing", "evidence")
    whole = sorted(answer_questions(asked, sources).select(*names).collect())

    def unasked(*args, **kwargs):
        raise AssertionError("retrieved")

    monkeypatch.setattr(ask, "retrieved_records", unasked)
    assert sorted(ask.question_evidence(asked, sources).select(*names).collect()) == whole
    assert all(row.evidence for row in whole)

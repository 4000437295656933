"""Scope and retrieval against plain Python restatements."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe import presets
from tallyframe.operators.questions import mentioned_sources, resolve_scope
from tallyframe.operators.retrieval import question_units, record_text, retrieve, retrieve_many
from tests.test_expressions import py_fold

ALL = list(presets.SURVEY_SOURCES)


def scope_of(spark, selected, question):
    df = spark.createDataFrame([(question, selected)], "question string, selected array<string>")
    return resolve_scope(df).first()


def test_scope_without_mention(spark):
    row = scope_of(spark, ["france"], "Quelle est la satisfaction moyenne ?")
    assert (row.effective, row.mode, row.conflict, row.warning) == (["france"], "interface", False, None)


def test_empty_or_unknown_selection_means_all_surveys(spark):
    assert scope_of(spark, [], "Bonjour").effective == ALL
    assert scope_of(spark, ["nope", ""], "Bonjour").selected == ALL


def test_mention_inside_the_selection_narrows(spark):
    row = scope_of(spark, ["maroc", "france"], "Et en FRANCE ?")
    assert (row.effective, row.mode, row.conflict) == (["france"], "question_subset", False)


def test_mention_outside_overrides_with_a_warning(spark):
    row = scope_of(spark, ["france"], "Compare la France et le Maroc.")
    assert (row.effective, row.mode, row.conflict) == (["france", "maroc"], "question_override", True)
    assert row.warning.startswith("La question mentionne France + Maroc alors que l'interface sélectionne France.")


def test_claims_only(spark):
    row = scope_of(spark, ["reclamations"], "Quelles sont les principales réclamations ?")
    assert (row.effective, row.conflict) == (["reclamations"], False)


def test_selection_order_is_kept(spark):
    assert scope_of(spark, ["maroc", "x", "allemagne"], "?").effective == ["maroc", "allemagne"]


def test_patterns_equal_restatement(spark):
    rng = random.Random(2)
    pieces = ["France", "français", "françaises", "Espagnole", "Spain", "marocaine", "Germany", "allemande", "canadienne", "Canada", "réclamation",
              "plaintes", "claim", "claims", "claimant", "réclams", "reclame", "clients", "et"]
    texts = [" ".join(rng.choices(pieces, k=4)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mentioned_sources("t").alias("m")).collect()
    for text, found in rows:
        folded = py_fold(text)
        assert found == [s for s, ps in presets.SOURCE_PATTERNS.items() if any(re.search(p, folded) for p in ps)], text


WORDS = ["colis", "retard", "express", "paris", "rouge", "bleu", "vert", "jaune", "tout", "rare"]


def corpus(spark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        # "tout" is in every row and "colis" in half of them.
        text = ["tout"] + rng.sample(WORDS[1:8], rng.randint(0, 4)) + (["colis"] if i % 2 else []) + (["rare"] if i in (17, 390) else [])
        rows.append((i, ["a", "b", "c"][i % 3], " ".join(text)))
    return rows, spark.createDataFrame(rows, "id bigint, src string, text string").repartition(5)


def tokens(text):
    return set(re.findall("[a-z0-9]+", py_fold(text)))


def best(rows, question, k, scope=None):
    asked = {w for w in tokens(question) if len(w) > 2 and w not in presets.STOP_WORDS}
    scored = []
    for key, src, text in rows:
        if scope is not None and src not in scope:
            continue
        overlap = len(asked & tokens(text))
        if overlap:
            scored.append((-overlap, scope.index(src) if scope else 0, key))
    return [(rank + 1, -o, key) for rank, (o, _, key) in enumerate(sorted(scored)[:k])]


QUESTIONS = ["Tout colis rouge", "le retard express bleu", "rare", "tout", "tout", "RARE vert ?", "the and", "inconnu mot", "Tout bleu vert jaune colis", "??"]


def test_one_question(spark):
    rows, df = corpus(spark)
    for question in ("Tout colis rouge", "rare", "inconnu"):
        found = [(i + 1, r.overlap, r.id) for i, r in enumerate(retrieve(df, question, "id", columns=["text"]).collect())]
        assert found == best(rows, question, 8)


@pytest.mark.parametrize("k, buckets", [(8, 64), (3, 2), (1, 1)])
def test_many_questions_equal_brute_force(spark, k, buckets):
    rows, df = corpus(spark)
    asked = question_units(spark.createDataFrame(list(enumerate(QUESTIONS)), "q int, question string"))
    found = asked.join(retrieve_many(df, asked, "id", k, text=F.col("text"), buckets=buckets), "unit").collect()
    for number, question in enumerate(QUESTIONS):
        got = sorted((r["rank"], r.overlap, r.id) for r in found if r.q == number)
        assert got == best(rows, question, k), question


def test_thousands_of_questions_read_the_rows_once(spark, tmp_path):
    rows, df = corpus(spark, 200)
    df.write.parquet(str(tmp_path / "rows"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = spark.read.parquet(str(tmp_path / "rows")).mapInArrow(seen, df.schema)
    questions = [f"{QUESTIONS[i % 4]} numero{i}" for i in range(6000)]
    asked = question_units(spark.createDataFrame(list(enumerate(questions)), "q int, question string"))
    best_rows = retrieve_many(counted, asked, "id", 3, text=F.col("text"))
    plan = best_rows._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    found = {}
    for r in asked.join(best_rows, "unit").collect():
        found.setdefault(r.q, []).append((r["rank"], r.overlap, r.id))
    assert read.value == len(rows)
    for number in range(0, 6000, 1499):
        assert sorted(found.get(number, [])) == best(rows, questions[number], 3)


def test_scope_orders_ties(spark):
    rows, df = corpus(spark)
    scopes = [["c", "a"], ["b"], ["a", "c", "b"], ["none"]]
    data = [(i, "tout colis", s) for i, s in enumerate(scopes)]
    asked = question_units(spark.createDataFrame(data, "q int, question string, scope array<string>"), scope="scope")
    best_rows = retrieve_many(df, asked, "id", 5, text=F.col("text"), source="src", scope="scope")
    found = asked.select("q", "unit").join(best_rows, "unit").collect()
    for number, scope in enumerate(scopes):
        got = sorted((r["rank"], r.overlap, r.id) for r in found if r.q == number)
        assert got == best(rows, "tout colis", 5, scope)


def test_no_usable_words(spark):
    _, df = corpus(spark, 10)
    asked = question_units(spark.createDataFrame([("the and ?",), (None,)], "question string"))
    assert asked.filter("unit is not null").count() == 0
    assert retrieve_many(df, asked, "id", text=F.col("text")).collect() == []


def test_bad_arguments(spark):
    _, df = corpus(spark, 10)
    with pytest.raises(ValueError, match="vide"):
        retrieve(df, "  ", "id")
    with pytest.raises(ValueError, match="top_k"):
        retrieve(df, "colis", "id", k=0)


def test_record_text_skips_missing(spark):
    df = spark.createDataFrame([(1, None, float("nan"), 1e7)], "a int, b string, c double, d double")
    assert df.select(record_text(df)).first()[0] == "1 10000000.0"

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import retrieval as module
from tallyframe.operators.retrieval import (
    _by_rarity,
    build_postings,
    candidates,
    question_units,
    retrieve_many,
    seeds,
    thresholds,
)

def texts(n, length, seed, variety=400):
    """Texts in which the first words are in nearly every one and the last in very few."""
    made = random.Random(seed)
    words, weights = [f"word{i}" for i in range(variety)], [1 / (i + 1) for i in range(variety)]
    return [" ".join(made.choices(words, weights, k=length)) for _ in range(n)]


def best(docs, question, k):
    asked = set(question.split())
    scored = sorted((-len(asked & set(text.split())), key) for key, text in docs)
    return [(key, -less) for less, key in scored[:k] if less]


@pytest.mark.parametrize("k, extra", [(1, 1), (3, 2), (8, 1), (8, 6)])
def test_equals_brute_force(spark, k, extra):
    docs = list(enumerate(texts(300, 12, 1) + ["word0 word1"] * 20))
    asked = texts(25, 6, 2) + ["word0", "word0 word1", "word399 word398", "word0 word399", "absent words"]
    rows = spark.createDataFrame(docs, "key long, text string").repartition(3)
    questions = question_units(spark.createDataFrame([(q,) for q in asked], "question string"))
    found = retrieve_many(rows, questions, "key", k, text=F.col("text"), extra=extra)
    lists = {}
    for r in questions.join(found, "unit").select("question", "rank", "key", "overlap").distinct().orderBy("rank").collect():
        lists.setdefault(r["question"], []).append((r["key"], r["overlap"]))
    with pytest.raises(ValueError):
        retrieve_many(rows, questions, "key", k, text=F.col("text"), extra=0)
    assert lists == {q: near for q in asked if (near := best(docs, q, k))}


def test_sources_of_a_scope_in_their_order(spark):
    docs = [("a", i, t) for i, t in enumerate(texts(120, 8, 3))] + [("b", i, t) for i, t in enumerate(texts(120, 8, 4))]
    rows = spark.createDataFrame(docs, "source string, key long, text string")
    asked = [(q, scope) for q in texts(10, 4, 5) for scope in (["b", "a"], ["a"], ["a", "b"], ["c"])]
    questions = question_units(spark.createDataFrame(asked, "question string, scope array<string>"), scope="scope")
    found = retrieve_many(rows, questions, "key", 5, text=F.col("text"), source="source", scope="scope")
    lists = {}
    for r in questions.join(found, "unit").distinct().orderBy("rank").collect():
        lists.setdefault((r["question"], tuple(r["scope"])), []).append((r["source"], r["key"], r["overlap"]))
    for question, scope in asked:
        words = set(question.split())
        scored = sorted((-len(words & set(t.split())), scope.index(s), k) for s, k, t in docs if s in scope)
        assert lists.get((question, tuple(scope)), []) == [(scope[p], k, -n) for n, p, k in scored[:5] if n]


def test_few_pairs_are_scored(spark):
    """Of all pairs of groups and questions that share a word, few are scored, and none for common words alone."""
    docs = spark.createDataFrame(list(enumerate(texts(10_000, 40, 6, 20_000))), "key long, text string")
    common = ["word0 word1 word2", "word1 word2", "word0 word3"]
    asked = question_units(spark.createDataFrame([(q,) for q in texts(40, 16, 7, 20_000) + common], "question string"))
    units = asked.select("unit", "words").distinct().cache()
    wanted = units.select("unit", F.lit("").alias("source"), F.lit(0).alias("place"), F.explode("words").alias("word"))
    narrow = docs.select("key", F.lit("").alias("source"), F.array_distinct(F.split("text", " ")).alias("words"))
    index = build_postings(narrow, wanted.select("source", "word").distinct(), 8)
    numbered = _by_rarity(wanted, index)
    scored = seeds(numbered, units, index)
    limits = thresholds(scored, 8)
    near = candidates(numbered, limits, index)
    pairs = index.groups.count() * units.count()
    assert scored.count() + near.count() < 0.05 * pairs
    few = asked.filter(F.col("question").isin(common)).select("unit")
    assert near.join(few, "unit").count() < 30 * len(common)


def test_lines_stay_where_their_group_is(spark, monkeypatch):
    """Lines of questions and groups that share rare words are counted and bounded without being moved."""
    monkeypatch.setattr(module, "BLOCK_WORDS", 20)
    docs = list(enumerate(texts(300, 12, 8)))
    asked = [*texts(30, 6, 9), "word0 word1"]
    rows = spark.createDataFrame(docs, "key long, text string").repartition(3)
    questions = question_units(spark.createDataFrame([(q,) for q in asked], "question string"))
    plans, anywhere = [], module._anywhere

    def seen(*args):
        lines = anywhere(*args)
        plans.append(lines._jdf.queryExecution().executedPlan().toString())
        return lines

    monkeypatch.setattr(module, "_anywhere", seen)
    found = retrieve_many(rows, questions, "key", 4, text=F.col("text"))
    assert len(plans) > 3
    # The groups are dealt out; nothing else is but the block of questions that is sent to them.
    assert all(plan.split("REPARTITION_BY_COL")[0].count("Exchange hashpartitioning") == 1 for plan in plans)
    lists = {}
    for r in questions.join(found, "unit").select("question", "rank", "key", "overlap").distinct().orderBy("rank").collect():
        lists.setdefault(r["question"], []).append((r["key"], r["overlap"]))
    assert lists == {q: near for q in asked if (near := best(docs, q, 4))}


def test_words_that_nobody_asks_are_not_moved(spark):
    """Also where Spark itself would broadcast nothing."""
    rows = spark.createDataFrame([("", i, t.split()) for i, t in enumerate(texts(50, 12, 10))], "source string, key long, words array<string>")
    asked = spark.createDataFrame([("", "word0"), ("", "word7")], "source string, word string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = module._alike(rows, asked, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_shared_word_is_no_row(spark, monkeypatch):
    """Groups are counted, bounded and scored without a row for each word they share with a question."""
    made = random.Random(11)
    docs = [(s, i, t) for s in "ab" for i, t in enumerate(texts(150, 10, 12 + ord(s)) + ["word0 word1 word2"] * 12)]
    made.shuffle(docs)
    rows = spark.createDataFrame(docs, "source string, key long, text string").repartition(5)
    asked = [(q, ["b", "a"]) for q in [*texts(20, 6, 13), "word0 word1 word2", "word399 absent"]]
    questions = question_units(spark.createDataFrame(asked, "question string, scope array<string>"), scope="scope")
    plans, anywhere = [], module._anywhere

    def seen(*args):
        lines = anywhere(*args)
        plans.append(lines._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_COL")[0])
        return lines

    monkeypatch.setattr(module, "_anywhere", seen)
    found = retrieve_many(rows, questions, "key", 4, text=F.col("text"), source="source", scope="scope")
    assert plans and not any(made in plan for plan in plans for made in ("Join", "Generate", "HashAggregate"))
    lists = {}
    for r in questions.join(found, "unit").select("question", "rank", "source", "key", "overlap").distinct().orderBy("rank").collect():
        lists.setdefault(r["question"], []).append((-r["overlap"], r["source"] == "a", r["key"]))
    for question, _ in asked:
        words = set(question.split())
        scored = sorted((-len(words & set(t.split())), s == "a", i) for s, i, t in docs)
        assert lists.get(question, []) == [line for line in scored[:4] if line[0]]

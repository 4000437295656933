"""Answering a table of questions from the sources."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, functions as F

from tallyframe.operators.attach import attach, measure
from tallyframe.operators.context import (
    RECORDS_BYTES,
    contexts,
    corpus_sources,
    evidence_lists,
    missing_messages,
    place_key,
    retrieved_records,
    scope_facts,
    scope_key,
    with_facts,
)
from tallyframe.operators.filters import FilterSpec
from tallyframe.operators.questions import resolve_scope
from tallyframe.operators.retrieval import DEFAULT_K, question_units
from tallyframe.plans.dashboard import cubes, filtered
from tallyframe.sources.readers import CLAIM_KIND, SURVEY_KIND, SourceSet


def question_facts(
    questions: DataFrame,
    sources: SourceSet,
    spec: FilterSpec = FilterSpec(),
    question: str = "question",
    selected: str = "selected",
) -> DataFrame:
    """Scope, facts, row count, summary and messages of unavailable sources of every question.

    The filtered sources are scanned once, for the cubes; nothing is retrieved.
    """
    scoped = resolve_scope(questions, question, selected)
    surveys, claims = cubes(sources, filtered(sources, list(sources.frames), spec), extra=["_source_id"])
    return _known(scoped, sources, surveys, claims)


def question_evidence(
    questions: DataFrame,
    sources: SourceSet,
    spec: FilterSpec = FilterSpec(),
    question: str = "question",
    selected: str = "selected",
) -> DataFrame:
    """``question_facts`` with the evidence of every question: the first rows of its scope.

    The filtered sources are scanned once for the facts and once for the first rows; nothing is retrieved.
    """
    frames = filtered(sources, list(sources.frames), spec)
    scoped = resolve_scope(questions, question, selected)
    surveys, claims = cubes(sources, frames, extra=["_source_id"])
    return _with_evidence(_known(scoped, sources, surveys, claims), scoped, sources, frames)


def answer_questions(
    questions: DataFrame,
    sources: SourceSet,
    spec: FilterSpec = FilterSpec(),
    question: str = "question",
    selected: str = "selected",
    k: int = DEFAULT_K,
) -> DataFrame:
    """``question_facts`` with evidence, best rows and context JSON of every question.

    Blank questions are an error of the caller: filter them out first. The filtered sources
    are scanned once for the facts and once for retrieval, whatever the number of questions.
    """
    frames = filtered(sources, list(sources.frames), spec)
    surveys, claims = cubes(sources, frames, extra=["_source_id"])
    counted = surveys.groupBy("_source_id").agg(F.sum("rows").alias("rows")).filter("rows > 0")
    # At most one name per declared source.
    filled = [row[0] for row in counted.collect()]
    filled = [s for s in sources.kinds(SURVEY_KIND) if s in filled]

    scoped = resolve_scope(questions, question, selected)
    corpus = corpus_sources("effective", filled, sources.kinds(CLAIM_KIND))
    units = question_units(scoped.withColumn("corpus", corpus), question, scope="corpus")
    known = _known(units, sources, surveys, claims)
    fields = [c for c in known.columns if c not in (*units.columns, "labels", "row_count", "summary", "missing")]
    keys = {source: sources.specs[source].order_key for source in frames}
    records = retrieved_records(units, frames, keys, k)
    unset = asdict(FilterSpec())
    active = {name: value for name, value in asdict(spec).items() if value != unset[name]}
    answered = contexts(known, fields, records, json.dumps(active, ensure_ascii=False, default=str))
    return _with_evidence(answered, scoped, sources, frames)


def _with_evidence(answered: DataFrame, scoped: DataFrame, sources: SourceSet, frames: Mapping[str, DataFrame]) -> DataFrame:
    keys = {source: sources.specs[source].order_key for source in frames}
    rows = measure(evidence_lists(scoped, frames, keys), ["place_key"], row_bytes=RECORDS_BYTES)
    return attach(answered.withColumn("place_key", place_key("effective")), rows).drop("place_key")


def _known(scoped: DataFrame, sources: SourceSet, surveys: DataFrame, claims: DataFrame) -> DataFrame:
    scopes = scoped.select("effective", scope_key("effective").alias("scope_key"))
    known = with_facts(scoped, scope_facts(scopes, surveys, claims))
    return known.withColumn("missing", missing_messages("effective", sources.errors))


def check_questions(questions: DataFrame, question: str = "question", columns: Sequence[str] = ()) -> None:
    """Fail on a blank question, naming a few of the rows."""
    blank = questions.filter(F.coalesce(F.trim(question), F.lit("")) == "")
    found = blank.select(*columns, question).limit(5).collect()
    if found:
        raise ValueError(f"La question ne peut pas être vide: {[r.asDict() for r in found]}")

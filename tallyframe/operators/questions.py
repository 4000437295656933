"""Which sources a question is about. Pure columns: works on batch and streaming tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe import presets
from tallyframe.functions.scoring import lookup
from tallyframe.functions.text import fold


def mentioned_sources(
    question: Column | str, patterns: Mapping[str, Sequence[str]] = presets.SOURCE_PATTERNS
) -> Column:
    """The sources whose patterns occur in the folded question, in catalog order."""
    text = fold(question)
    found = [
        F.when(text.rlike("(?U)" + "|".join(f"(?:{p})" for p in alternatives)), F.lit(source))
        for source, alternatives in patterns.items()
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def source_labels(ids: Column, labels: Mapping[str, str] = presets.SOURCE_LABELS) -> Column:
    return F.filter(F.transform(ids, lambda x: lookup(x, labels)), lambda x: x.isNotNull())


def resolve_scope(
    df: DataFrame,
    question: str = "question",
    selected: str = "selected",
    patterns: Mapping[str, Sequence[str]] = presets.SOURCE_PATTERNS,
    labels: Mapping[str, str] = presets.SOURCE_LABELS,
    default_sources: Sequence[str] = presets.SURVEY_SOURCES,
    warning: str = presets.SCOPE_WARNING,
) -> DataFrame:
    """Add the scope of each question to a table with an array column of selected sources.

    Unknown selected sources are dropped and an empty selection means all surveys. Sources
    the question names narrow the selection, or override it with a visible conflict.
    """
    known = F.filter(F.col(selected), lambda x: x.isin(*labels))
    default = F.array(*[F.lit(s) for s in default_sources])
    scoped = df.withColumn("mentioned", mentioned_sources(question, patterns)).withColumn(
        selected, F.when(F.size(known) > 0, known).otherwise(default)
    )
    named = F.size("mentioned") > 0
    inside = F.size(F.array_except("mentioned", selected)) == 0
    conflict = named & ~inside
    text = F.format_string(
        warning,
        F.array_join(source_labels(F.col("mentioned"), labels), " + "),
        F.array_join(source_labels(F.col(selected), labels), " + "),
    )
    return scoped.withColumns(
        {
            "effective": F.when(named, F.col("mentioned")).otherwise(F.col(selected)),
            "mode": F.when(~named, "interface").when(inside, "question_subset").otherwise("question_override"),
            "conflict": conflict,
            "warning": F.when(conflict, text),
        }
    )

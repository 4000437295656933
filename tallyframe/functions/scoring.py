"""Score and product expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from tallyframe import presets
from tallyframe.functions.cast import num
from tallyframe.functions.text import fold_present


def lexicon_score(column: Column | str, lexicon: Mapping[str, tuple[str, ...]] = presets.LEXICON) -> Column:
    """Score free text on five by phrases first, then by distinct whole-word hits.

    A strong phrase decides alone: 5 or 1. Otherwise 3 is neutral; a good word without a bad
    one adds 1, two bad words or a single one without a good word take 1 away. Written as a
    sum of flags instead of nested conditions, so that the folded text and the hits are each
    computed once per row; a null text makes every flag null.
    """
    raw = F.col(column) if isinstance(column, str) else column
    text = fold_present(raw)

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    # A whole-word hit is a maximal run of word characters that equals the word.
    runs = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))

    def phrase_in(name: str) -> Column:
        return flag(reduce(Column.__or__, [text.contains(phrase) for phrase in lexicon[name]]))

    def hits(name: str) -> Column:
        broken = [word for word in lexicon[name] if not re.fullmatch(r"\w+", word)]
        if broken:
            raise ValueError(f"lexicon words must be single words: {broken}")
        return F.size(F.array_intersect(runs, F.array(*[F.lit(word) for word in lexicon[name]])))

    best, worst = phrase_in("strong_positive"), phrase_in("strong_negative")
    good, bad = hits("positive"), hits("negative")
    some_good, one_bad, two_bad = flag(good > 0), flag(bad == 1), flag(bad >= 2)
    by_hits = 3 + some_good * (1 - one_bad - two_bad) - one_bad * (1 - some_good) - two_bad
    return best * 5 + (1 - best) * (worst + (1 - worst) * by_hits)


def in_range(column: Column, low: float, high: float) -> Column:
    """Null outside the inclusive range; the row itself is kept."""
    return F.when(column.between(low, high), column)


def lookup(column: Column, table: Mapping[str, object]) -> Column:
    """Exact match in a small fixed table, else null."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), column)


def rule_score(
    rule: Mapping[str, object],
    dtype: T.DataType | None = None,
    score_range: tuple[float, float] = presets.SCORE_RANGE,
    lexicon: Mapping[str, tuple[str, ...]] = presets.LEXICON,
) -> Column:
    """One source's raw score brought to the common scale, as its rule says."""
    column = F.col(rule["column"])
    kind = rule["kind"]
    if kind == "number":
        score = num(column, dtype)
        if "divide_by" in rule:
            score = score / F.lit(rule["divide_by"])
    elif kind == "ordinal":
        score = lookup(column.cast("string"), rule["levels"])
    elif kind == "lexicon":
        # Always a whole number from 1 to 5.
        low, high = score_range
        score = lexicon_score(column, lexicon)
        return score if low <= 1 and high >= 5 else in_range(score, low, high)
    else:
        raise ValueError(f"unknown score rule: {kind}")
    return in_range(score, *score_range)


def score_by_source(
    source: Column,
    rules: Mapping[str, Mapping[str, object]] = presets.SCORE_RULES,
    lexicon: Mapping[str, tuple[str, ...]] = presets.LEXICON,
    dtypes: Mapping[str, T.DataType] | None = None,
    score_range: tuple[float, float] = presets.SCORE_RANGE,
) -> Column:
    """The rule of each row's source, for tables that hold several sources.

    A source without a rule fails the job rather than passing as a missing score.
    """
    chain = None
    for name, rule in rules.items():
        score = rule_score(rule, (dtypes or {}).get(rule["column"]), score_range, lexicon)
        matches = source == name
        chain = F.when(matches, score) if chain is None else chain.when(matches, score)
    unknown = F.raise_error(F.concat(F.lit("no score rule for source: "), F.coalesce(source, F.lit("null"))))
    return chain.otherwise(unknown.cast("double"))


def product_from_code(
    column: Column | str,
    codes: Mapping[str, str] = presets.CLAIM_PRODUCTS,
    pattern: str = presets.CLAIM_PRODUCT_PATTERN,
) -> Column:
    """Product by upper-cased code, else the first product name in the text as written."""
    c = (F.col(column) if isinstance(column, str) else column).cast("string")
    found = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(lookup(F.upper(c), codes), found)

"""Text expressions: accent folding, tokens, trimming and printing of values."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F, types as T

from tallyframe.presets import STOP_WORDS


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str]:
    """Accented letters and their single base letters, derived from the Unicode data."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        decomposed = unicodedata.normalize("NFD", letter)
        if decomposed == letter:
            continue
        base = [ch for ch in decomposed if unicodedata.category(ch) != "Mn"]
        if len(base) == 1:
            source.append(letter)
            target.append(base[0])
    return "".join(source), "".join(target)


# Hangul syllables lie in order of their leads, vowels and tails; the first tail is none.
_SYLLABLES = ("\uac00", "\ud7a3")
_LEADS = "".join(chr(0x1100 + i) for i in range(19))
_VOWELS = "".join(chr(0x1161 + i) for i in range(21))
_TAILS = "".join(chr(0x11A7 + i) for i in range(28))


@lru_cache(maxsize=1)
def _several_bases() -> dict[str, str]:
    """Letters other than Hangul that decompose to several base letters."""
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        if _SYLLABLES[0] <= letter <= _SYLLABLES[1]:
            continue
        base = "".join(ch for ch in unicodedata.normalize("NFD", letter) if unicodedata.category(ch) != "Mn")
        if len(base) > 1:
            found[letter] = base
    return found


def _split_bases(text: Column) -> Column:
    """Letters of several bases as those; texts without such letters are left as they are."""
    table = _several_bases()
    bases = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    syllables = f"[{_SYLLABLES[0]}-{_SYLLABLES[1]}]"

    def one(letter: Column) -> Column:
        place = F.ascii(letter) - ord(_SYLLABLES[0])
        tail = place % 28
        jamo = F.concat(
            F.substr(F.lit(_LEADS), F.floor(place / 588).cast("int") + 1, F.lit(1)),
            F.substr(F.lit(_VOWELS), F.floor(place % 588 / 28).cast("int") + 1, F.lit(1)),
            F.when(tail > 0, F.substr(F.lit(_TAILS), tail + 1, F.lit(1))).otherwise(""),
        )
        return F.when(letter.rlike(syllables), jamo).otherwise(F.coalesce(bases[letter], letter))

    some = text.rlike(f"[{_SYLLABLES[0]}-{_SYLLABLES[1]}{''.join(table)}]")
    return F.when(some, F.concat_ws("", F.transform(F.split(text, ""), one))).otherwise(text)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def fold_present(column: Column | str) -> Column:
    """Lower case without accents; null stays null.

    A text with as many bytes as characters is plain ASCII, where lower case is all there is to do.
    """
    source, target = _accent_tables()
    text = _col(column).cast("string")
    plain = F.octet_length(text) == F.length(text)
    lowered = F.translate(F.lower(text), source, target)
    # Asked of the text as it came, by one range: most texts are then folded once and not searched further.
    rare = text.rlike(f"[{min(_several_bases())}-\U0010ffff]")
    folded = F.regexp_replace(F.when(rare, _split_bases(lowered)).otherwise(lowered), r"\p{Mn}", "")
    return F.when(plain, F.lower(text)).otherwise(folded)


def fold(column: Column | str) -> Column:
    """Lower case without accents; null becomes the empty text."""
    return F.coalesce(fold_present(column), F.lit(""))


@lru_cache(maxsize=1)
def _white_space() -> str:
    return "".join(chr(code) for code in range(0x10000) if chr(code).isspace())


def strip(column: Column | str) -> Column:
    """Trim every kind of white space (Spark's ``trim`` alone removes blanks only)."""
    return F.btrim(_col(column), F.lit(_white_space()))


def words(column: Column | str) -> Column:
    """Distinct folded tokens of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(fold(column), F.lit("[a-z0-9]+"), F.lit(0)))


def query_words(column: Column | str, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens a question is matched by: longer than two letters, no stop words."""
    kept = F.filter(words(column), lambda w: F.length(w) > 2)
    return F.array_except(kept, F.array(*[F.lit(w) for w in stop_words]))


def _double_text(c: Column) -> Column:
    """Shortest decimal text, with an exponent only below 1e-4 and from 1e16 on."""
    java = c.cast("string")
    plain = java.try_cast("decimal(38,21)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    # An exponent of three digits is not padded, and lpad would cut it.
    scientific = F.when(
        F.abs(exponent) >= 100,
        F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.abs(exponent).cast("string")),
    ).otherwise(scientific)
    size = F.abs(c)
    return (
        F.when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), trimmed)
        .otherwise(scientific)
    )


def value_text(column: Column | str, dtype: T.DataType) -> Column:
    """A cell as printed text: 10000000.0 rather than 1.0E7; null stays null.

    Used by the value filters, the row search and retrieval, which compare printed values.
    """
    c = _col(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _double_text(F.nanvl(c.cast("double"), F.lit(None)))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def missing_text(dtype: T.DataType) -> str:
    """How the row search prints a missing cell."""
    return "NaT" if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "nan"

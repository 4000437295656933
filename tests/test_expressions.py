"""Column expressions against plain Python restatements of their rules."""

from __future__ import annotations

import datetime
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F, types as T

from tallyframe import presets
from tallyframe.functions.cast import clip, num, ts, without_nan
from tallyframe.functions.scoring import lexicon_score, product_from_code, score_by_source
from tallyframe.functions.text import fold, query_words, strip, value_text, words


def py_fold(text):
    lowered = "" if text is None else text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", lowered) if unicodedata.category(c) != "Mn")


TEXTS = [
    None, "", "École ÀÉÎÕÜ ñ Ç", "İstanbul ΆΣ", "été dès", "tres insatisfait", "ß œ ø",
    "ｆｕｌｌ width", "a b", "ÅÅ K", "ǅungla", "naïve—façade 42", "Ё й",
]


def test_fold_equals_unicode_decomposition(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", fold("t").alias("f")).collect()
    for text, folded in rows:
        assert folded == py_fold(text), repr(text)


def test_words_and_stop_words(spark):
    df = spark.createDataFrame([("Où est la Satisfaction, la satisfaction de l'été 2024 ?",)], "t string")
    row = df.select(words("t").alias("w"), query_words("t").alias("q")).first()
    assert sorted(row.w) == sorted({"ou", "est", "la", "satisfaction", "de", "l", "ete", "2024"})
    assert sorted(row.q) == ["2024", "ete", "satisfaction"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("3", 3.0), (" 4.5 ", 4.5), ("1e3", 1000.0), ("-.5", -0.5), ("x", None), ("1.0d", None), ("", None),
        (None, None), ("1,5", None), ("0x10", None), ("nan", None), ("5.", 5.0), ("+7", 7.0),
    ],
)
def test_number_or_null(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(num("t")).first()[0] == expected


def test_infinity_and_booleans_are_numbers(spark):
    df = spark.createDataFrame([("-inf", True)], "t string, b boolean")
    assert df.select(num("t"), num("b", T.BooleanType())).first() == (float("-inf"), 1.0)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"), float("nan")), (2.0, 1.0)], "a double, b float")
    row = without_nan(df).agg(F.avg("a"), F.count("a"), F.max("b")).first()
    assert tuple(row) == (2.0, 1, 1.0)
    assert df.select(num("a", T.DoubleType())).collect()[0][0] is None


def test_timestamps(spark):
    df = spark.createDataFrame([("2026-01-05",), ("05/01/2026 10:30",), ("never",), (None,)], "t string")
    plain = [r[0] for r in df.select(ts("t")).collect()]
    assert plain == [datetime.datetime(2026, 1, 5), None, None, None]
    more = [r[0] for r in df.select(ts("t", ("dd/MM/yyyy HH:mm",))).collect()]
    assert more[1] == datetime.datetime(2026, 1, 5, 10, 30)


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("\t\n  a b  \r",)], "t string")
    assert df.select(strip("t")).first()[0] == "a b"


def test_clip_leaves_missing_missing(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (3.0,), (30.0,)], "v double")
    assert [r[0] for r in df.select(clip(F.col("v"), F.lit(0.0), F.lit(10.0))).collect()] == [None, 0.0, 3.0, 10.0]
    unbounded = clip(F.col("v"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    assert [r[0] for r in df.select(unbounded).collect()] == [None, -3.0, 3.0, 30.0]


def test_printed_doubles_look_like_python(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1.0, 10000000.0, 123456789.25, 1e15, 1e16, 1.5e22, 1e100, 0.001, 0.0001, 0.00015, 1e-5, 2.5e-7, -3.25e9, 1e-100]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 18) for _ in range(300)]
    values += [float(rng.randint(1, 10**15)) for _ in range(50)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_text("v", T.DoubleType())).collect()
    wrong = [(repr(v), t) for v, t in rows if float(t) != v or (t != repr(v) and len(t) <= len(repr(v)))]
    assert not wrong
    special = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    assert [r[0] for r in special.select(value_text("v", T.DoubleType())).collect()] == ["inf", "-inf", None]


def py_lexicon(text):
    if text is None:
        return None
    folded, lex = py_fold(text), presets.LEXICON
    if any(p in folded for p in lex["strong_positive"]):
        return 5.0
    if any(p in folded for p in lex["strong_negative"]):
        return 1.0
    good = sum(1 for w in lex["positive"] if re.search(rf"\b{w}\b", folded))
    bad = sum(1 for w in lex["negative"] if re.search(rf"\b{w}\b", folded))
    table = {(True, True): 3.0, (True, False): 2.0, (False, True): 4.0, (False, False): 3.0}
    return 2.0 if bad >= 2 else table[(bad > 0, good > 0)]


def test_lexicon_equals_restatement(spark):
    rng = random.Random(3)
    pieces = [*presets.LEXICON["positive"], *presets.LEXICON["negative"], "Très insatisfait", "tout était PARFAIT", "colis",
              "lentement", "endommagé", "problème", "decevant-retard", "bien_fait", "rapide.", "(mauvais)", "satisfaite", "œuvre", "42"]
    texts = [None, ""] + [" ".join(rng.choices(pieces, k=rng.randint(1, 5))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lexicon_score("t").alias("s")).collect()
    assert [(t, s) for t, s in rows if s != py_lexicon(t)] == []


def test_fixture_comments(spark):
    expected = {
        "Tout était PARFAIT, merci": 5.0, "Très insatisfait du colis": 1.0, "Retard et colis endommagé": 2.0,
        "Livreur professionnel mais retard": 3.0, "Un problème de suivi": 2.0, "Service rapide": 4.0,
        "Cliente satisfaite": 3.0, "insatisfait": 2.0,
    }
    rows = spark.createDataFrame([(t,) for t in expected], "t string").select("t", lexicon_score("t")).collect()
    assert dict(map(tuple, rows)) == expected


def test_lexicon_words_must_be_single(spark):
    with pytest.raises(ValueError, match="single words"):
        lexicon_score("t", {**presets.LEXICON, "positive": ("tres bien",)})


def test_products_from_codes(spark):
    expected = {
        "COLIS_EXPRESS": "EXPRESS", "colis_standard": "STANDARD", "X_PREMIUM_9": "PREMIUM", "x_premium_9": None, "Premium": "PREMIUM", "": None,
    }
    rows = spark.createDataFrame([(t,) for t in [*expected, None]], "t string").select("t", product_from_code("t")).collect()
    assert dict(map(tuple, rows)) == {**expected, None: None}


def test_unknown_source_fails(spark):
    df = spark.createDataFrame([("Italie", "3", None)], "source string, satisfaction_globale string, commentaire_global string")
    with pytest.raises(Exception, match="no score rule for source: Italie"):
        df.select(score_by_source(F.col("source"))).collect()


def test_score_rules(spark):
    rows = [
        ("France", "4", None, 4.0), ("France", "9", None, None), ("Canada", "9", None, 4.5), ("Canada", "1", None, None),
        ("Espagne", "Alto", None, 5.0), ("Espagne", "alto", None, None), ("Allemagne", "x", None, None),
        ("Maroc", "1", "Service rapide", 4.0), ("Maroc", None, None, None),
    ]
    df = spark.createDataFrame(rows, "source string, satisfaction_globale string, commentaire_global string, want double")
    for row in df.select("*", score_by_source(F.col("source")).alias("got")).collect():
        assert row.got == row.want, row


def test_fold_covers_unicode(spark):
    import sys
    import unicodedata

    letters = [
        ch for ch in map(chr, range(0x80, sys.maxunicode + 1))
        if unicodedata.normalize("NFD", ch) != ch and ch.lower() == ch and unicodedata.category(ch) != "Mn"
    ]
    df = spark.createDataFrame([(ch, f"<{ch}a{ch}>") for ch in letters], "letter string, text string")
    for letter, text, folded in df.select("letter", "text", fold("text")).collect():
        want = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        assert folded == want, (hex(ord(letter)), folded, want)

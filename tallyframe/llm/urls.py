"""URL filters: rules on host and path, and a logistic regression on hashed character n-grams.

A rule decides where one fits; elsewhere the model does. Everything is native expressions: features are
hashed by the engine, each gradient step is one small aggregate over the labelled table, and the weights
(one double per bucket) are a literal of the scoring plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4)

#: Rules as (verdict, host and start of path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: A small labelled table: URLs to block and to allow.
BLOCKED_URLS = (
    "http://cheap-pills.example.com/en/10", "https://www.cheap-pills.example.net/buy/now", "http://cheap-meds.test/order?id=1",
    "http://pills-online.test/cheap", "https://ads-track.example.org/en/3", "http://ads-track.example.net/click?u=4",
    "http://ads.example.test/banner/1.gif", "https://track-ads.test/pixel", "http://adserver.test/popup/77",
    "http://casino-win.example.com/play", "https://www.best-casino.test/bonus", "http://free-casino.example.org/slots",
    "http://poker-bonus.test/win", "https://adult-cams.test/live", "http://xxx-videos.test/watch/9",
    "http://hot-porn.test/", "https://free-torrent.test/download.exe", "http://warez-crack.test/keygen.zip",
    "http://win-prize.test/claim?ref=mail", "https://payday-loans.test/apply", "http://click-tracker.test/r?u=8",
    "https://m.cheap-pills.example.org/fr/2", "https://blog.casino-win.example.net/de/5", "http://m.ads-track.example.com/es/6",
)
ALLOWED_URLS = (
    "http://www.library.example.org/en/10", "https://docs.example.com/en/guide.html", "http://blog.example.net/fr/375",
    "https://news.example.com/de/2024/05/01", "http://wiki.example.org/en/History", "https://en.example.net/articles/12",
    "http://m.weather.example.com/es/101/", "https://blog.garden.example.org/en/671?utm_source=feed", "http://university.test/physics/",
    "https://www.museum.test/collection/4", "http://recipes.test/bread.html", "https://forum.example.com/en/453#top",
    "http://science.example.net/fr/878", "https://journal.example.org/de/59?page=2&ref=x", "http://www.city.example.com/en/391",
    "https://books.test/chapter/3", "http://school.example.net/es/797", "https://m.travel.example.org/en/323.html",
    "http://www.thenand.example.com/en/231", "https://thattion.example.org/en/657", "http://blog.onthe.example.net/en/790",
    "https://m.inghe.example.org/de/196/", "http://theration.example.com/fr/438", "https://www.ndther.example.net/es/150.html",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for a null or where no ``://`` stands."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(F.regexp_substr(rest, F.lit(r"(?s)^[^?#]+")), F.lit(""))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise("")
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(url.isNull(), "").otherwise(host), F.when(url.isNull(), "").otherwise(path)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null; among rules of equal length the longer host wins.

    The rules are a short list held in the plan.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def features(host: Column, path: Column, buckets: int = BUCKETS, grams: Sequence[int] = GRAMS) -> Column:
    """Buckets of the character n-grams of host and path, repeats included."""

    def of(part: Column, kind: str) -> list[Column]:
        # Marks of the ends let a gram tell the first label of a host from an inner one.
        marked = F.concat(F.lit("^"), F.lower(part), F.lit("$"))
        return [
            F.when(
                F.length(marked) >= n,
                F.transform(
                    F.sequence(F.lit(1), F.length(marked) - (n - 1)),
                    lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substr(marked, i, F.lit(n))), F.lit(buckets)).cast("int"),
                ),
            ).otherwise(F.array().cast("array<int>"))
            for n in grams
        ]

    return F.concat(*of(host, "host"), *of(path, "path"))


def _weights(values: Sequence[float]) -> Column:
    """The weights as one constant array; folded into a literal when the plan is optimized."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast("array<double>")


def _chance(found: Column, weights: Sequence[float]) -> Column:
    """The model's probability of a row with these features; the last weight is the bias."""
    held = _weights(weights)
    total = F.aggregate(found, F.lit(0.0), lambda a, f: a + F.get(held, f))
    scaled = total / F.sqrt(F.greatest(F.size(found), F.lit(1)))
    return 1 / (1 + F.exp(-(scaled + F.lit(float(weights[-1])))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table that comes with the library: url and blocked (1 or 0)."""
    rows = [(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS]
    return spark.createDataFrame(rows, "url string, blocked int").coalesce(1)


def train(labelled: DataFrame, buckets: int = BUCKETS, steps: int = 20, rate: float = 40.0, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic regression, by full gradient steps; one aggregate a step.

    ``labelled`` has url and blocked. What comes to the driver is one number per bucket, whatever the
    table's size. Rows with a null label are left out; with no rows, all weights are 0 (chance 1/2).
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("blocked IS NOT NULL").select(
        F.col("blocked").cast("double").alias("y"), features(host, path, buckets).alias("found")
    ).persist()
    weights = [0.0] * (buckets + 1)
    try:
        n = rows.count()
        for step in range(steps if n else 0):
            error = (_chance(F.col("found"), weights) - F.col("y")) / n
            slopes = (
                rows.select(error.alias("e"), (error / F.sqrt(F.greatest(F.size("found"), F.lit(1)))).alias("scaled"), "found")
                .select(F.explode(F.concat("found", F.array(F.lit(buckets)))).alias("at"),  "e", "scaled")
                .groupBy("at")
                .agg(F.sum(F.when(F.col("at") == buckets, F.col("e")).otherwise(F.col("scaled"))).alias("slope"))
                .collect()
            )
            weights = [w * (1 - decay) for w in weights]
            for row in slopes:
                weights[row["at"]] -= rate / math.sqrt(1 + step) * row["slope"]
    finally:
        rows.unpersist()
    return weights


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    limit: float = 0.5,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """The kept columns with host, path, rule, verdict and ``chance``, the model's probability of a block.

    The verdict is that of the longest fitting rule, else ``block`` where the chance passes ``limit``.
    A null URL or one without ``://`` has an empty host and path, fits no rule, and is left to the model,
    which sees no text but the end marks. Repeated rows are judged alike; an empty table gives an empty
    result; other columns are not read. URLs of any length are judged whole.
    """
    weights = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col(url))
    split = pages.select(*keep, host.alias("host"), path.alias("path"))
    judged = split.select(
        *keep, "host", "path", matched_rule(F.col("host"), F.col("path"), rules).alias("matched"),
        _chance(features(F.col("host"), F.col("path")), weights).alias("chance"),
    )
    verdict = F.coalesce("matched.verdict", F.when(F.col("chance") > limit, "block").otherwise("allow"))
    return judged.select(*keep, "host", "path", F.col("matched.rule").alias("rule"), verdict.alias("verdict"), "chance")

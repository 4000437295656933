"""Facts, summary text and model context for a table of questions.

Facts are computed once per distinct scope, from cubes, and retrieval once per distinct
question; both then join back to the questions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe import presets
from tallyframe.functions.cast import ref, round3, without_nan
from tallyframe.operators.attach import attach, measure
from tallyframe.operators.facts import TOP_CATEGORIES, evidence
from tallyframe.operators.metrics import measured
from tallyframe.operators.questions import source_labels
from tallyframe.operators.retrieval import DEFAULT_K, question_units, record_text, retrieve_many
from tallyframe.operators.schema import union_aligned

SUMMARY_CATEGORIES = 5
EVIDENCE_ROWS = 8
# Retrieved lists are wide rows, so fewer of them fit the bound of a broadcast.
RECORDS_BYTES = 16_000


def scope_key(effective: Column | str) -> Column:
    """Scopes with the same sources share their facts, whatever the order."""
    return F.array_join(F.array_sort(effective), ",")


def _listed(df: DataFrame, name: str, *order: Column, limit: int | None = None) -> DataFrame:
    """One ordered list per scope of the few group lines of a cube."""
    fields = [c for c in df.columns if c != "scope_key"]
    line = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *fields)
    lists = df.groupBy("scope_key").agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    kept = F.col("_lines") if limit is None else F.slice("_lines", 1, limit)
    plain = F.transform(kept, lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return lists.select("scope_key", plain.alias(name))


def _means(cube: DataFrame, group: str, name: str, descending: bool) -> DataFrame:
    scored = measured(cube.filter(ref(group).isNotNull()), ["scope_key", group], None).filter("scored > 0")
    mean = F.col("total") / F.col("scored")
    lines = scored.select(
        "scope_key",
        ref(group).alias("label"),
        round3(mean).alias("mean"),
        F.col("scored").alias("count"),
        round3(F.col("total")).alias("total"),
        mean.alias("_mean"),
    )
    listed = _listed(lines, name, -F.col("_mean") if descending else F.col("_mean"), F.col("label"))
    return listed.withColumn(
        name, F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in ("label", "mean", "count", "total")]))
    )


def _counts(cube: DataFrame, group: str, name: str, limit: int | None = None) -> DataFrame:
    counted = cube.filter(ref(group).isNotNull()).groupBy("scope_key", ref(group).alias("label"))
    lines = counted.agg(F.sum("rows").alias("count"))
    return _listed(lines, name, -F.col("count"), F.col("label"), limit=limit)


def scope_facts(scopes: DataFrame, surveys: DataFrame, claims: DataFrame) -> DataFrame:
    """All facts of each scope in one row.

    ``scopes`` holds ``scope_key`` and ``effective``; the cubes carry ``_source_id``. Every
    intermediate table has at most scopes x categories rows. The distinct scopes are taken
    from the questions once.
    """
    distinct = measure(scopes.dropDuplicates(["scope_key"]), ["scope_key"]).table
    members = distinct.select("scope_key", F.explode("effective").alias("_source_id"))
    seen = surveys.join(members, "_source_id")
    claimed = claims.join(members, "_source_id")
    totals = measured(seen, ["scope_key"], None).select(
        "scope_key",
        F.col("rows").alias("responses"),
        F.col("scored").alias("valid_scores"),
        round3(F.try_divide("total", "scored")).alias("mean"),
        round3(F.col("low")).alias("min"),
        round3(F.col("high")).alias("max"),
        round3(F.try_divide("good", "scored") * 100).alias("good_rate_pct"),
        round3(F.col("total")).alias("total"),
    )
    counted = claimed.groupBy("scope_key").agg(F.sum("rows").alias("claims"))
    parts = [
        totals,
        _means(seen, "country", "by_country", descending=True),
        _means(seen, "product", "by_product", descending=False),
        counted,
        _counts(claimed, "category", "claim_categories", TOP_CATEGORIES),
        _counts(claimed, "country", "claims_by_country"),
        _counts(claimed, "status", "claims_by_status"),
    ]
    facts = reduce(lambda a, b: a.join(b, "scope_key", "left"), [distinct.select("scope_key"), *parts])
    zero = F.lit(0).cast("bigint")
    return facts.withColumns(
        {
            "responses": F.coalesce("responses", zero),
            "valid_scores": F.coalesce("valid_scores", zero),
            "claims": F.coalesce("claims", zero),
            "weakest_product": F.get("by_product", F.lit(0)),
            "strongest_product": F.try_element_at("by_product", F.lit(-1)),
        }
    )


def summary_text() -> Column:
    """The answer that the facts alone allow, from the columns of ``scope_facts``.

    Expects ``labels`` (array) and ``warning`` beside the facts. ``format_number`` rounds the
    exact value half to even; ``format_string`` would round the printed one up.
    """
    joined = F.array_join("labels", " · ")
    heading = F.when(F.size("labels") == 1, "Source analysée").otherwise("Sources analysées")
    preamble = F.when(F.size("labels") > 0, F.concat_ws("\n", heading, joined, F.lit(""), F.lit("Réponse")))
    warned = F.when(
        F.col("warning").isNotNull(), F.concat(F.lit("Avertissement : "), F.col("warning"), F.lit("\n"))
    )
    spaced = F.translate(F.format_number("responses", 0), ",", " ")
    weakest = F.col("weakest_product")
    compared = F.transform(
        "by_country",
        lambda x: F.format_string("- %s : %s / 5 (%d réponses)", x["label"], F.format_number(x["mean"], 2), x["count"]),
    )
    surveys = F.when(
        F.col("mean").isNotNull(),
        F.concat_ws(
            "\n",
            F.concat(joined, F.lit(" · "), spaced, F.lit(" réponses")),
            F.format_string("Satisfaction moyenne : %s / 5", F.format_number("mean", 2)),
            F.format_string("Taux de notes >= 4 : %s %%", F.format_number("good_rate_pct", 1)),
            F.when(
                weakest.isNotNull(),
                F.format_string(
                    "Le produit avec la satisfaction moyenne la plus faible est %s avec %s / 5 (%d notes).",
                    weakest["label"], F.format_number(weakest["mean"], 2), weakest["count"],
                ),
            ),
            F.when(F.size("by_country") > 1, F.concat_ws("\n", F.lit("\nComparaison par pays :"), compared)),
        ),
    )
    first = F.transform(
        F.slice("claim_categories", 1, SUMMARY_CATEGORIES),
        lambda x: F.format_string("- %s : %d", x["label"], x["count"]),
    )
    claims = F.when(
        F.col("claims") > 0,
        F.concat_ws(
            "\n",
            F.format_string("\nRéclamations : %d", "claims"),
            F.when(F.size("claim_categories") > 0, F.concat_ws("\n", F.lit("Principales catégories :"), first)),
        ),
    )
    apart = F.when((F.col("responses") > 0) & (F.col("claims") > 0), F.lit("\n" + presets.NO_ROW_JOIN))
    nothing = F.when(
        surveys.isNull() & claims.isNull() & F.col("warning").isNull(),
        F.lit("Aucune statistique calculable sur le périmètre sélectionné."),
    )
    return F.trim(F.concat_ws("\n", preamble, F.lit(""), warned, surveys, claims, apart, nothing))


def corpus_sources(effective: Column | str, filled_surveys: Sequence[str], claim_sources: Sequence[str]) -> Column:
    """What a question searches: its surveys if they hold rows, else its claims."""
    surveys = F.array_intersect(effective, _texts(filled_surveys))
    return F.when(F.size(surveys) > 0, surveys).otherwise(F.array_intersect(effective, _texts(claim_sources)))


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def retrieved_records(
    questions: DataFrame,
    frames: Mapping[str, DataFrame],
    order_keys: Mapping[str, str],
    k: int = DEFAULT_K,
    scope: str = "corpus",
) -> DataFrame:
    """Per unit the list of its best rows as JSON, in rank order.

    ``questions`` comes from ``question_units`` with the same scope column.
    """
    json = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    cleaned = {source: without_nan(df) for source, df in frames.items()}
    parts = [
        df.select(F.lit(source).alias("source"), ref(order_keys[source]).alias("key"), record_text(df).alias("text"))
        for source, df in cleaned.items()
    ]
    rows = union_aligned(parts)
    best = measure(
        retrieve_many(rows, questions, "key", k, text=F.col("text"), source="source", scope=scope),
        ["source", "key"],
    ).table
    names = ["_source", "_key"]
    chosen = measure(best.select("source", "key").distinct().toDF(*names), names)
    # Only the chosen rows are printed: the join comes first, on the bare columns.
    records = []
    for source, df in cleaned.items():
        keyed = df.withColumns({"_source": F.lit(source), "_key": ref(order_keys[source]).cast(best.schema["key"].dataType)})
        found = attach(keyed, chosen, "inner")
        record = F.to_json(F.struct(*[ref(c) for c in df.columns]), json)
        records.append(found.select(F.col("_source").alias("source"), F.col("_key").alias("key"), record.alias("record")))
    texts = union_aligned(records)
    lines = best.join(texts, ["source", "key"])
    listed = lines.groupBy("unit").agg(
        F.sort_array(F.collect_list(F.struct("rank", "overlap", "source", "record"))).alias("retrieved")
    )
    return listed


def evidence_lists(
    scopes: DataFrame, frames: Mapping[str, DataFrame], order_keys: Mapping[str, str], limit: int = EVIDENCE_ROWS
) -> DataFrame:
    """Per ordered scope (``place_key``) the list of a few first rows of each of its sources as JSON.

    ``scopes`` holds ``effective``. The sources of a scope share ``limit`` evenly. Every source
    gives at most ``limit`` rows, whatever the number of scopes.
    """
    asked = scopes.select("effective", place_key("effective").alias("place_key")).dropDuplicates(["place_key"])
    present = F.array_intersect("effective", _texts(list(frames)))
    members = asked.select("place_key", F.size(present).alias("_n"), F.posexplode(present).alias("position", "source"))
    first = evidence(frames, order_keys, limit * len(frames)).select("source", "rank", "record")
    share = F.greatest(F.floor(F.lit(limit) / F.col("_n")), F.lit(1))
    lines = members.join(first, "source").filter(F.col("rank") <= share)
    line = F.struct("position", "rank", "source", "record")
    listed = F.slice(F.sort_array(F.collect_list(line)), 1, limit)
    plain = F.transform(listed, lambda x: F.struct(*[x[f].alias(f) for f in ("source", "rank", "record")]))
    return lines.groupBy("place_key").agg(plain.alias("evidence"))


def place_key(effective: Column | str) -> Column:
    """Scopes with the same sources in the same order share their evidence."""
    return F.array_join(effective, ",")


def missing_messages(effective: Column | str, errors: Mapping[str, str]) -> Column:
    """The messages of a scope's unavailable sources, in the order of the scope."""
    if not errors:
        return F.array().cast("array<string>")
    said = F.create_map(*[F.lit(x) for pair in errors.items() for x in pair])
    return F.filter(F.transform(effective, lambda s: F.try_element_at(said, s)), lambda m: m.isNotNull())


def with_facts(scoped: DataFrame, facts: DataFrame) -> DataFrame:
    """The questions with the facts of their scope, its labels, row count and summary text."""
    keyed = scoped.withColumns(
        {"scope_key": scope_key("effective"), "labels": source_labels(F.col("effective"))}
    )
    joined = attach(keyed, measure(facts, ["scope_key"])).drop("scope_key")
    return joined.withColumns(
        {"row_count": F.col("responses") + F.col("claims"), "summary": summary_text()}
    )


def contexts(
    known: DataFrame,
    fact_fields: Sequence[str],
    records: DataFrame,
    filters: str = "{}",
) -> DataFrame:
    """``known`` with the best rows of each question and the whole context as JSON.

    ``known`` comes from ``with_facts`` and has ``unit``.
    """
    joined = attach(known, measure(records, ["unit"], row_bytes=RECORDS_BYTES))
    statistics = F.struct(
        *[F.col(c) for c in ("responses", "valid_scores", "total", "mean", "by_product", "by_country")]
    )
    context = F.struct(
        F.col("labels").alias("sources"),
        "mode",
        "conflict",
        "warning",
        F.lit(filters).alias("filters"),
        F.struct(*fact_fields).alias("facts"),
        statistics.alias("statistics"),
        F.coalesce("retrieved", F.array().cast(records.schema["retrieved"].dataType)).alias("rows"),
        F.lit(presets.NO_ROW_JOIN).alias("link"),
    )
    return joined.withColumn("context", F.to_json(context, {"ignoreNullFields": "false"})).select(
        *known.columns, "retrieved", "context"
    )

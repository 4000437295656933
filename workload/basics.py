"""Queries: scalar expressions, scores, reading, writing and schema operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe import presets
from tallyframe.functions.cast import clip, month_key, num, round3, ts
from tallyframe.functions.scoring import in_range, lexicon_score, product_from_code, score_by_source
from tallyframe.functions.text import fold, query_words, strip, value_text, words
from tallyframe.operators.products import add_product, preset_lookup, product_lookup, product_reference, unmapped_codes
from tallyframe.operators.schema import align_union, canonical_country, standardize_all, union_tagged
from tallyframe.plans.wrangle import normalization_audit
from tallyframe.session import scratch_path
from tallyframe.sources.readers import SourceSet, SourceSpec, read_same_schema, read_table, read_tables, tag
from tallyframe.sources.sinks import to_records, write_normalized, write_standardized
from tallyframe.streaming.rows import file_stream, write_available
from workload.registry import (
    CLAIM_PRODUCT_SQL,
    fold_sql,
    lexicon_sql,
    query,
    query_tokens_sql,
    tokens_sql,
)
from workload.sets import catalog, normalized, source_set
from workload.views import BRANCHES, raw_sources, table, view

# --- Scalar functions ------------------------------------------------------------------


@query("fold_text", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fold("text").alias("folded"))


@query(
    "word_tokens",
    f"""SELECT doc_id, len({tokens_sql('text')}) AS n_words, len({query_tokens_sql('text')}) AS n_query_words,
      array_to_string(list_sort({query_tokens_sql('text')}), ' ') AS query_words FROM documents""",
)
def word_tokens(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.size(words("text")).alias("n_words"),
        F.size(query_words("text")).alias("n_query_words"),
        F.array_join(F.array_sort(query_words("text")), " ").alias("query_words"),
    )


@query(
    "number_or_null",
    """SELECT 'score' AS kind, gesamtzufriedenheit AS raw, try_cast(gesamtzufriedenheit AS DOUBLE) AS number,
      count(*) AS n FROM raw_allemagne GROUP BY ALL
    UNION ALL SELECT 'code', code_produit_global, try_cast(code_produit_global AS DOUBLE), count(*) FROM claims GROUP BY ALL""",
    uses=("raw_allemagne", "claims"),
)
def number_or_null(spark, sf):
    scores = view(spark, sf, "raw_allemagne").select(
        F.lit("score").alias("kind"), F.col("gesamtzufriedenheit").alias("raw")
    )
    codes = view(spark, sf, "claims").select(F.lit("code"), F.col("code_produit_global"))
    both = scores.union(codes).withColumn("number", num("raw"))
    return both.groupBy("kind", "raw", "number").agg(F.count(F.lit(1)).alias("n"))


@query(
    "timestamp_or_null",
    """SELECT event_id, strftime(try_cast(t AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS stamp FROM (
      SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events)""",
)
def timestamp_or_null(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select(
        "event_id", F.date_format(ts(text), "yyyy-MM-dd HH:mm:ss").alias("stamp")
    )


@query(
    "month_keys",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL",
)
def month_keys(spark, sf):
    return (
        table(spark, sf, "orders").groupBy(month_key("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "strip_white_space",
    r"""SELECT event_id, regexp_replace(concat(chr(9), chr(160), ' ', sla_respecte, chr(10)), '^[\s\xA0]+|[\s\xA0]+$', '', 'g') AS stripped
    FROM (SELECT event_id, sla_respecte FROM events JOIN claims ON colis_id = concat('COL-', lpad(CAST(event_id AS STRING), 12, '0')))
    WHERE sla_respecte IS NOT NULL""",
    uses=("claims",),
)
def strip_white_space(spark, sf):
    claims = view(spark, sf, "claims").filter("sla_respecte is not null")
    padded = F.concat(F.lit("\t  "), "sla_respecte", F.lit("\n"))
    return claims.select(
        F.regexp_extract("colis_id", r"\d+", 0).cast("bigint").alias("event_id"), strip(padded).alias("stripped")
    )


@query(
    "comment_scores",
    f"SELECT id_enquete, {lexicon_sql('commentaire_global')} AS score FROM raw_maroc "
    f"UNION ALL SELECT CAST(doc_id AS VARCHAR), {lexicon_sql('text')} FROM documents",
    uses=("raw_maroc",),
)
def comment_scores(spark, sf):
    comments = view(spark, sf, "raw_maroc").select("id_enquete", F.col("commentaire_global").alias("text"))
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("string"), "text")
    return comments.union(documents).select("id_enquete", lexicon_score("text").alias("score"))


@query(
    "scores_by_source",
    "SELECT id_unique, source, satisfaction_normalisee AS score FROM norm",
    uses=("norm",),
)
def scores_by_source(spark, sf):
    """One table of several sources: the rule is chosen by the source column of the row."""
    standard = union_tagged(standardize_all(raw_sources(spark, sf)))
    return standard.select(
        F.col("id_enquete").alias("id_unique"), "source", score_by_source(F.col("source")).alias("score")
    )


@query(
    "product_from_code",
    f"SELECT colis_id, code_produit_global, {CLAIM_PRODUCT_SQL} AS product FROM claims",
    uses=("claims",),
)
def product_codes(spark, sf):
    return view(spark, sf, "claims").select(
        "colis_id", "code_produit_global", product_from_code("code_produit_global").alias("product")
    )


@query(
    "round_three",
    "SELECT l_returnflag, CAST(l_discount AS VARCHAR) AS discount, round(avg(l_extendedprice / 1000), 3) AS mean "
    "FROM lineitem GROUP BY ALL",
)
def round_three(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag", F.col("l_discount").cast("string").alias("discount"))
        .agg(round3(F.avg(F.col("l_extendedprice") / 1000)).alias("mean"))
    )


@query(
    "clip_values",
    "SELECT id, CASE WHEN price IS NULL THEN NULL ELSE least(greatest(price, 100000), 300000) END AS clipped FROM gaps",
    uses=("gaps",),
)
def clip_values(spark, sf):
    low, high = F.lit(100000.0), F.lit(300000.0)
    return view(spark, sf, "gaps").select("id", clip(F.col("price"), low, high).alias("clipped"))


@query(
    "score_range_guard",
    "SELECT id_enquete, CASE WHEN satisfaction_globale BETWEEN 1 AND 5 THEN satisfaction_globale END AS score FROM raw_france",
    uses=("raw_france",),
)
def score_range_guard(spark, sf):
    return view(spark, sf, "raw_france").select(
        "id_enquete", in_range(F.col("satisfaction_globale"), *presets.SCORE_RANGE).alias("score")
    )


@query(
    "printed_numbers",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice * 1000 AS VARCHAR) AS large, "
    "CAST(l_tax / 512 AS VARCHAR) AS small FROM lineitem",
)
def printed_numbers(spark, sf):
    from pyspark.sql import types as T

    lines = table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        value_text(F.col("l_extendedprice") * 1000, T.DoubleType()).alias("large"),
        value_text(F.col("l_tax") / 512, T.DoubleType()).alias("small"),
    )


# --- Sources and sinks -------------------------------------------------------------------


@query(
    "read_nested_records",
    """SELECT event_id, event_type AS "detail.type", CAST(json_extract(props, '$.k') AS INT) AS "detail.inner.k" FROM events""",
)
def read_nested_records(spark, sf):
    events = table(spark, sf, "events")
    inner = F.from_json("props", "k int")
    nested = events.select(
        "event_id", F.struct(F.col("event_type").alias("type"), inner.alias("inner")).alias("detail")
    )
    path = scratch_path(spark, "records") + ".jsonl"
    nested.write.json(path)
    schema = "event_id bigint, detail struct<type: string, inner: struct<k: int>>"
    return read_table(spark, path, schema)


@query(
    "read_declared_tables",
    "SELECT 'orders' AS source, count(*) AS n, 6 AS columns FROM orders UNION ALL SELECT 'events', count(*), 6 FROM events "
    "UNION ALL SELECT 'nation', count(*), 3 FROM nation",
)
def read_declared_tables(spark, sf):
    frames = read_tables(spark, {n: f"{sf}/{n}.parquet" for n in ("orders", "events", "nation")})
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("source"), "n", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in frames.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "read_same_schema",
    "SELECT 'orders' AS source, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
)
def read_same_schema_query(spark, sf):
    df = read_same_schema(spark, {"orders": f"{sf}/orders.parquet"})
    return df.groupBy("source", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_inventory",
    """SELECT 'orders' AS id, true AS available, CAST(NULL AS VARCHAR) AS error, count(*) AS rows, 9 AS n_columns FROM orders
    UNION ALL SELECT 'events', true, NULL, count(*), 9 FROM events
    UNION ALL SELECT 'absent', false, 'Fichier introuvable: absent.parquet', 0, 0
    UNION ALL SELECT 'sheet', false, 'Impossible de lire events.xlsx: ValueError', 0, 0""",
)
def source_inventory(spark, sf):
    specs = [
        SourceSpec("orders", "Orders", "satisfaction", f"{sf}/orders.parquet"),
        SourceSpec("events", "Events", "satisfaction", f"{sf}/events.parquet"),
        SourceSpec("absent", "Absent", "satisfaction", f"{sf}/absent.parquet"),
        SourceSpec("sheet", "Sheet", "satisfaction", f"{sf}/events.xlsx"),
    ]
    found = SourceSet.load(spark, tuple(specs)).inventory(spark)
    return found.select("id", "available", "error", "rows", "n_columns")


@query(
    "tag_survey_rows",
    """SELECT id_enquete AS id_unique, 'france' AS _source_id, 'France' AS _source_label, 'satisfaction' AS _kind,
      strftime(date_enquete, '%Y-%m-%d') AS day, satisfaction_globale AS score FROM raw_france""",
    uses=("raw_france",),
)
def tag_survey_rows(spark, sf):
    raw = view(spark, sf, "raw_france").select(
        F.col("id_enquete").alias("id_unique"),
        F.date_format("date_enquete", "yyyy-MM-dd").alias("date_enquete"),
        F.col("satisfaction_globale").cast("string").alias("satisfaction_normalisee"),
    )
    return tag(raw, catalog()[0]).select(
        "id_unique", "_source_id", "_source_label", "_kind",
        F.date_format("date_enquete", "yyyy-MM-dd").alias("day"),
        F.col("satisfaction_normalisee").alias("score"),
    )


@query(
    "tag_claim_rows",
    """SELECT colis_id, 'reclamations' AS _source_id, 'reclamations' AS _kind, produit_global,
      strftime(date_reclamation, '%Y-%m-%d %H:%M:%S') AS stamp FROM claim""",
    uses=("claim",),
)
def tag_claim_rows(spark, sf):
    return tag(view(spark, sf, "claims"), catalog()[5]).select(
        "colis_id", "_source_id", "_kind", "produit_global",
        F.date_format("date_reclamation", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
    )


_ABSENT = {b: [c for c in presets.CANONICAL_COLUMNS if c not in presets.COLUMN_MAPS[b].values()] for b in BRANCHES}


@query(
    "write_standardized",
    "\nUNION ALL\n".join(
        f"SELECT '{b}' AS country, count(*) AS rows, 15 AS columns, '{', '.join(_ABSENT[b])}' AS missing_columns, "
        f"'success' AS status FROM raw_{b.lower()}"
        for b in BRANCHES
    ),
    uses=tuple(f"raw_{b.lower()}" for b in BRANCHES),
)
def write_standardized_query(spark, sf):
    standard = standardize_all(raw_sources(spark, sf))
    audit = write_standardized(standard, scratch_path(spark, "standard"))
    return audit.select("country", "rows", "columns", "missing_columns", "status")


_NORM_SUMMARY = """SELECT source, count(*) AS n, count(satisfaction_normalisee) AS scored,
  round(sum(satisfaction_normalisee), 3) AS total, min(id_unique) AS first_id, max(id_unique) AS last_id
  FROM norm GROUP BY source"""


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("satisfaction_normalisee").alias("scored"),
        F.round(F.sum("satisfaction_normalisee"), 3).alias("total"),
        F.min("id_unique").alias("first_id"),
        F.max("id_unique").alias("last_id"),
    )


@query("write_normalized", _NORM_SUMMARY, uses=("norm",))
def write_normalized_query(spark, sf):
    _, consolidated = normalized(spark, sf)
    paths = write_normalized(consolidated, product_reference(spark), scratch_path(spark, "normal"))
    return _summary(spark.read.parquet(paths["table"]))


@query(
    "product_reference_use",
    """SELECT source AS pays, code_produit AS code, produit_global AS product, count(*) AS n FROM norm GROUP BY ALL""",
    uses=("norm",),
)
def product_reference_use(spark, sf):
    """The reference table joined to the codes that occur, with their row counts."""
    reference = product_reference(spark)
    standard = union_tagged(standardize_all(raw_sources(spark, sf)))
    seen = standard.groupBy(F.col("source").alias("pays"), F.col("code_produit").alias("code_produit_source")).count()
    return reference.join(seen, ["pays", "code_produit_source"]).select(
        "pays", F.col("code_produit_source").alias("code"), F.col("produit_global").alias("product"), F.col("count").alias("n")
    )


@query(
    "write_export",
    """SELECT label, count(*) AS n, count(produit_global) AS products FROM (
      SELECT source AS label, produit_global FROM norm WHERE satisfaction_normalisee >= 4
      UNION ALL SELECT 'Réclamations', produit_global FROM claim) GROUP BY label""",
    uses=("norm", "claim"),
)
def write_export_query(spark, sf):
    from tallyframe.operators.filters import FilterSpec
    from tallyframe.plans.dashboard import export

    sources = source_set(spark, sf)
    path = export(sources, list(sources.specs), scratch_path(spark, "export"), FilterSpec(score_min=4))
    back = spark.read.csv(path, header=True)
    return back.groupBy(F.col("_source_label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count("produit_global").alias("products")
    )


@query(
    "json_records",
    """SELECT concat('{"id":', CAST(id AS VARCHAR), ',"source":"', source, '","priority":',
      coalesce('"' || priority || '"', 'null'), ',"at":"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000'), '"}') AS record
    FROM gaps JOIN orders ON id = o_orderkey""",
    uses=("gaps",),
)
def json_records(spark, sf):
    gaps = view(spark, sf, "gaps")
    orders = table(spark, sf, "orders")
    rows = gaps.join(orders, gaps["id"] == orders["o_orderkey"])
    return to_records(rows.select("id", "source", "priority", F.col("o_orderdate").cast("timestamp").alias("at")))


# --- Schema ---------------------------------------------------------------------------------

_STANDARD_COLUMNS = """id_enquete, strftime(date_enquete, '%Y-%m-%d') AS day, pays, code_produit, taille_colis, fragile,
  round(poids_kg, 4) AS poids_kg, round(prix_livraison_eur, 4) AS prix, statut_colis, delai_livraison, relation_livreur,
  etat_colis, service_client, satisfaction_globale, commentaire_global"""


@query("standardize_schema", f"SELECT source, {_STANDARD_COLUMNS} FROM standard", uses=("standard",))
def standardize_schema(spark, sf):
    standard = union_tagged(standardize_all(raw_sources(spark, sf)))
    return standard.select(
        "source", "id_enquete", F.date_format("date_enquete", "yyyy-MM-dd").alias("day"), "pays", "code_produit",
        "taille_colis", "fragile", F.round("poids_kg", 4).alias("poids_kg"),
        F.round("prix_livraison_eur", 4).alias("prix"), "statut_colis",
        *[F.col(c).cast("double").alias(c) for c in ("delai_livraison", "relation_livreur", "etat_colis", "service_client")],
        "satisfaction_globale", "commentaire_global",
    )


@query(
    "standardize_all_audit",
    "SELECT source, count(*) AS n, count(satisfaction_globale) AS scored, count(commentaire_global) AS comments, "
    "count(DISTINCT pays) AS countries FROM standard GROUP BY source",
    uses=("standard",),
)
def standardize_all_audit(spark, sf):
    return union_tagged(standardize_all(raw_sources(spark, sf))).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("satisfaction_globale").alias("scored"),
        F.count("commentaire_global").alias("comments"),
        F.count_distinct("pays").alias("countries"),
    )


@query(
    "country_alias",
    "SELECT source AS pays, pays AS written, count(*) AS n FROM standard GROUP BY ALL",
    uses=("standard",),
)
def country_alias(spark, sf):
    standard = union_tagged(standardize_all(raw_sources(spark, sf)))
    return standard.groupBy(canonical_country(F.col("pays")).alias("pays"), F.col("pays").alias("written")).agg(
        F.count(F.lit(1)).alias("n")
    )


_FINAL = """id_unique, strftime(date_enquete, '%Y-%m-%d') AS day, pays, code_produit, produit_global, taille_colis, fragile,
  round(poids_kg, 4) AS poids_kg, round(prix_livraison_eur, 4) AS prix, statut_colis,
  round(satisfaction_normalisee, 4) AS score, commentaire_global"""


def final_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id_unique", F.date_format("date_enquete", "yyyy-MM-dd").alias("day"), "pays", "code_produit", "produit_global",
        "taille_colis", "fragile", F.round("poids_kg", 4).alias("poids_kg"),
        F.round("prix_livraison_eur", 4).alias("prix"), "statut_colis",
        F.round("satisfaction_normalisee", 4).alias("score"), "commentaire_global",
    )


@query("normalize_all", f"SELECT {_FINAL} FROM norm", uses=("norm",))
def normalize_all_query(spark, sf):
    return final_columns(normalized(spark, sf)[1])


@query(
    "normalization_audit",
    """SELECT source, count(*) AS rows, 12 AS columns, count(satisfaction_normalisee) AS scored,
      count(*) FILTER (produit_global IS NULL) AS unmapped FROM norm GROUP BY source""",
    uses=("norm",),
)
def normalization_audit_query(spark, sf):
    return normalization_audit(normalized(spark, sf)[1], len(presets.FINAL_COLUMNS))


@query(
    "final_projection",
    f"SELECT {_FINAL} FROM norm WHERE source = 'Maroc'",
    uses=("norm",),
)
def final_projection(spark, sf):
    return final_columns(normalized(spark, sf)[0]["Maroc"])


@query(
    "combined_table",
    """SELECT source AS _source_label, 'satisfaction' AS _kind, id_unique, pays, produit_global, satisfaction_normalisee AS score,
      CAST(NULL AS VARCHAR) AS colis_id, CAST(NULL AS VARCHAR) AS categorie_reclamation FROM norm
    UNION ALL SELECT 'Réclamations', 'reclamations', NULL, pays, produit_global, NULL, colis_id, categorie_reclamation FROM claim""",
    uses=("norm", "claim"),
)
def combined_table_query(spark, sf):
    combined = align_union(source_set(spark, sf).frames)
    return combined.select(
        "_source_label", "_kind", "id_unique", "pays", "produit_global",
        F.col("satisfaction_normalisee").alias("score"), "colis_id", "categorie_reclamation",
    )


@query(
    "union_mixed_types",
    """SELECT CAST(o_orderkey AS VARCHAR) AS code, CAST(o_totalprice AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS kind FROM orders
    UNION ALL SELECT event_type, CAST(user_id AS DOUBLE), event_type FROM events""",
)
def union_mixed_types(spark, sf):
    from tallyframe.operators.schema import union_aligned

    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("code"), F.col("o_totalprice").alias("amount"))
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("code"), F.col("user_id").alias("amount"), F.col("event_type").alias("kind")
    )
    return union_aligned([orders, events])


@query(
    "split_by_kind",
    "SELECT 'satisfaction' AS kind, count(*) AS n, count(DISTINCT source) AS sources FROM norm "
    "UNION ALL SELECT 'reclamations', count(*), 1 FROM claim",
    uses=("norm", "claim"),
)
def split_by_kind_query(spark, sf):
    from tallyframe.operators.schema import split_by_kind

    sources = source_set(spark, sf)
    groups = split_by_kind(sources.frames, {s: spec.kind for s, spec in sources.specs.items()})
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_source_id").alias("sources")).select(
            F.lit(kind).alias("kind"), "n", "sources"
        )
        for kind, df in groups.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "union_same_schema",
    "SELECT source, count(*) AS n, count(DISTINCT id_unique) AS ids FROM norm GROUP BY source",
    uses=("norm",),
)
def union_same_schema(spark, sf):
    _, consolidated = normalized(spark, sf)
    return consolidated.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id_unique").alias("ids")
    )


# --- Product lookups ---------------------------------------------------------------------------


@query(
    "product_lookup",
    "SELECT id_unique, pays, code_produit, produit_global FROM norm",
    uses=("norm",),
)
def product_lookup_query(spark, sf):
    standard = union_tagged(standardize_all(raw_sources(spark, sf)))
    found = add_product(standard, product_lookup(product_reference(spark)))
    return found.select(F.col("id_enquete").alias("id_unique"), "pays", "code_produit", "produit_global")


@query(
    "unmapped_products",
    "SELECT DISTINCT pays, code_produit FROM norm WHERE code_produit IN ('PAK_002', 'PARCEL_PREMIUM')",
    uses=("norm",),
)
def unmapped_products(spark, sf):
    codes = dict(presets.PRODUCT_CODES)
    short = product_reference(spark, codes).filter("code_produit_source not in ('PAK_002', 'PARCEL_PREMIUM')")
    standard = union_tagged(standardize_all(raw_sources(spark, sf)))
    return unmapped_codes(add_product(standard, product_lookup(short)))


# --- Streams -------------------------------------------------------------------------------------


@query("stream_fold_documents", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def stream_fold_documents(spark, sf):
    schema = table(spark, sf, "documents").schema
    stream = file_stream(spark, sf, schema, name_pattern="documents.parquet")
    out = scratch_path(spark, "stream-out")
    write_available(stream, lambda df: df.select("doc_id", fold("text").alias("folded")), out)
    return spark.read.schema("doc_id bigint, folded string").parquet(out)


@query(
    "stream_tag_and_filter_events",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error') AND value >= 3",
)
def stream_tag_and_filter_events(spark, sf):
    from tallyframe.operators.filters import FilterSpec, apply_filters

    schema = table(spark, sf, "events").schema
    stream = file_stream(spark, sf, schema, name_pattern="events.parquet")
    out = scratch_path(spark, "stream-out")
    spec = FilterSpec(values={"event_type": [" Click", "ERROR"]}, score_column="value", score_min=3)
    write_available(stream, lambda df: apply_filters(df, spec).select("event_id", "event_type"), out)
    return spark.read.schema("event_id bigint, event_type string").parquet(out)

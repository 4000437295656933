"""Queries: filters, profiling reports, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import presets
from tallyframe.operators.clean import (
    cap_outliers,
    category_stats,
    correction_log,
    fill_categories,
    imputation_log,
    imputation_stats,
    impute_numeric,
    weak_columns,
)
from tallyframe.operators.filters import FilterSpec, apply_filters, apply_to_all
from tallyframe.operators.profile import (
    compare_missing,
    correlations,
    duplicate_rows,
    low_correlation_candidates,
    missing_report,
    outlier_report,
    profile,
    structure_report,
)
from tallyframe.operators.schema import align_union
from tallyframe.plans.quality import normalized_profiles
from workload.registry import query
from workload.sets import claim_rows, source_set, survey_rows
from workload.views import BRANCHES, raw_sources, stored_view, table, view

# --- Filters -----------------------------------------------------------------------------


@query(
    "filter_values",
    """SELECT id_unique FROM norm WHERE lower(trim(fragile)) IN ('oui') AND lower(trim(produit_global)) IN ('express', 'premium')""",
    uses=("norm",),
)
def filter_values(spark, sf):
    spec = FilterSpec(values={"fragile": [" OUI "], "produit_global": ["Express", "premium"], "taille_colis": []})
    return apply_filters(survey_rows(spark, sf), spec).select("id_unique")


@query(
    "filter_country_or_chart",
    "SELECT id_unique FROM norm WHERE pays IN ('France', 'Maroc')",
    uses=("norm",),
)
def filter_country_or_chart(spark, sf):
    spec = FilterSpec(values={"pays": ["france"]}, chart_values=["MAROC"])
    return apply_filters(survey_rows(spark, sf), spec).select("id_unique")


@query(
    "filter_score_range",
    "SELECT id_unique, satisfaction_normalisee AS score FROM norm WHERE satisfaction_normalisee >= 2 AND satisfaction_normalisee <= 3.5",
    uses=("norm",),
)
def filter_score_range(spark, sf):
    found = apply_filters(survey_rows(spark, sf), FilterSpec(score_min=2, score_max=3.5))
    return found.select("id_unique", F.col("satisfaction_normalisee").alias("score"))


@query(
    "filter_date_range",
    """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 23:59:59'""",
)
def filter_date_range(spark, sf):
    spec = FilterSpec(date_start="2024-01-05", date_end="2024-01-09", date_columns=("ts",))
    return apply_filters(table(spark, sf, "events"), spec).select("event_id")


@query(
    "filter_bad_date_bound",
    """SELECT 'good' AS bound, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05'
    UNION ALL SELECT 'bad', event_id FROM events WHERE false""",
)
def filter_bad_date_bound(spark, sf):
    """A bound that is no date keeps nothing; a good one beside it keeps its rows."""
    events = table(spark, sf, "events")
    kept = [
        apply_filters(events, FilterSpec(date_start=start, date_columns=("ts",))).select(F.lit(bound).alias("bound"), "event_id")
        for bound, start in (("good", "2024-01-05"), ("bad", "not a date"))
    ]
    return kept[0].unionByName(kept[1])


@query(
    "search_rows_pattern",
    """SELECT id_unique FROM norm WHERE regexp_matches(lower(concat_ws(' ', id_unique,
      strftime(date_enquete, '%Y-%m-%d %H:%M:%S'), pays, code_produit, produit_global, coalesce(taille_colis, 'nan'),
      coalesce(fragile, 'nan'), coalesce(CAST(poids_kg AS VARCHAR), 'nan'), coalesce(CAST(prix_livraison_eur AS VARCHAR), 'nan'),
      statut_colis, coalesce(CAST(satisfaction_normalisee AS VARCHAR), 'nan'), coalesce(commentaire_global, 'nan'), source)),
      '(retour 5\\.0 nan|1997-0[1-3]-\\d+ .*premium nan|nan livre nan .*retard)')""",
    uses=("norm",),
)
def search_rows_pattern(spark, sf):
    needle = r"(retour 5\.0 nan|1997-0[1-3]-\d+ .*premium nan|nan livre nan .*retard)"
    return apply_filters(survey_rows(spark, sf), FilterSpec(search=needle.upper())).select("id_unique")


@query(
    "search_documents_literal",
    "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', doc_id, text, lang, source, n_chars)), 'en src1')",
)
def search_documents_literal(spark, sf):
    spec = FilterSpec(search="EN src1", search_literal=True)
    return apply_filters(table(spark, sf, "documents"), spec).select("doc_id")


_FILTERED = """SELECT source AS label, id_unique AS id FROM norm WHERE pays IN ('France', 'Espagne')
    AND satisfaction_normalisee >= 3 AND date_enquete >= TIMESTAMP '1996-01-01'
    AND date_enquete <= TIMESTAMP '2024-01-09 23:59:59'"""


@query(
    "filter_all_sources",
    f"""{_FILTERED} UNION ALL SELECT 'Réclamations', colis_id FROM claim WHERE pays IN ('France', 'Espagne')
      AND date_reclamation <= TIMESTAMP '2024-01-09 23:59:59'
    UNION ALL SELECT 'all claims', colis_id FROM claim""",
    uses=("norm", "claim"),
)
def filter_all_sources(spark, sf):
    """One spec over unlike sources: a score filter leaves claims alone."""
    sources = source_set(spark, sf)
    spec = FilterSpec(
        values={"pays": ["France", "Espagne"]}, score_min=3, date_start="1996-01-01", date_end="2024-01-09"
    )
    kept = align_union(apply_to_all(sources.frames, spec))
    scored = apply_to_all({"reclamations": sources.frames["reclamations"]}, FilterSpec(score_min=5))["reclamations"]
    ids = kept.select(F.col("_source_label").alias("label"), F.coalesce("id_unique", "colis_id").alias("id"))
    return ids.union(scored.select(F.lit("all claims"), F.col("colis_id")))


@query(
    "filtered_mean_by_country",
    """SELECT pays AS label, round(avg(satisfaction_normalisee), 3) AS value, count(satisfaction_normalisee) AS count
    FROM norm WHERE satisfaction_normalisee >= 2 AND date_enquete >= TIMESTAMP '1996-01-01'
      AND date_enquete <= TIMESTAMP '2000-06-30 23:59:59' AND produit_global IN ('STANDARD', 'EXPRESS') GROUP BY pays""",
    uses=("norm",),
)
def filtered_mean_by_country(spark, sf):
    from tallyframe.operators.metrics import group_mean

    spec = FilterSpec(
        values={"produit_global": ["standard", "express"]}, score_min=2, date_start="1996-01-01", date_end="2000-06-30"
    )
    return group_mean(apply_filters(survey_rows(spark, sf), spec), "pays")


# --- Profiling ------------------------------------------------------------------------------

_LINE_COLUMNS = ("l_orderkey", "l_linenumber", "quantity", "satisfaction", "discount", "tax", "constant", "linestatus")


def missing_sql(view_name: str, columns, source: str = "source") -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT {source} AS source, '{c}' AS "column", count(*) - count({c}) AS missing_count, count(*) AS row_count,
          round((count(*) - count({c})) / count(*) * 100, 2) AS missing_rate_pct FROM {view_name} GROUP BY 1"""
        for c in columns
    )


#: How the columns that aren't text print their type.
_TYPES = {
    "l_orderkey": "bigint", "l_linenumber": "int",
    **dict.fromkeys(("quantity", "satisfaction", "discount", "tax", "constant"), "double"),
}


def typed(report: str) -> str:
    """A report in SQL with the type of each column."""
    arms = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in _TYPES.items())
    return f"""SELECT *, CASE "column" {arms} ELSE 'string' END AS dtype FROM ({report})"""


@query("missing_report", typed(missing_sql("lines", _LINE_COLUMNS)), uses=("lines",))
def missing_report_query(spark, sf):
    return missing_report(view(spark, sf, "lines"), ["source"])


def raw_names(branch: str) -> list[str]:
    by_canonical = {c: n for n, c in presets.COLUMN_MAPS[branch].items()}
    return [by_canonical[c] for c in presets.CANONICAL_COLUMNS if c in by_canonical]


def numeric_names(branch: str) -> list[str]:
    """The numeric raw columns of a branch: its details, and the score where it is a number."""
    if branch == "Maroc":
        return ["poids_kg", "prix_livraison_eur"]
    names = {c: n for n, c in presets.COLUMN_MAPS[branch].items()}
    details = ["poids_kg", "prix_livraison_eur", "delai_livraison", "relation_livreur", "etat_colis", "service_client"]
    score = ["satisfaction_globale"] if branch in ("France", "Canada") else []
    return [names[c] for c in details + score]


_RAW_VIEWS = tuple(f"raw_{b.lower()}" for b in BRANCHES)


@query(
    "missing_report_unlike_sources",
    "\nUNION ALL\n".join(missing_sql(f"raw_{b.lower()}", raw_names(b), f"'{b}'") for b in BRANCHES),
    uses=_RAW_VIEWS,
)
def missing_report_unlike_sources(spark, sf):
    return missing_report(raw_sources(spark, sf)).drop("dtype")


def _missing_total(columns) -> str:
    return " + ".join(f"(count(*) - count({c}))" for c in columns)


_GAP_COLUMNS = ("id", "price", "balance", "rating", "priority", "status")


@query(
    "profile_sources",
    f"""SELECT g.source, rows, total_missing, 6 AS columns, 4 AS numeric_columns, 2 AS categorical_columns,
      round(total_missing / (rows * 6) * 100, 2) AS missing_rate_global_pct, 'rating' AS target_column,
      CAST(duplicate_rows AS BIGINT) AS duplicate_rows
    FROM (SELECT source, count(*) AS rows, {_missing_total(_GAP_COLUMNS)} AS total_missing FROM gaps GROUP BY source) g
    JOIN (SELECT source, sum(n - 1) AS duplicate_rows FROM (SELECT source, count(*) AS n FROM gaps GROUP BY ALL,
      id, price, balance, rating, priority, status) GROUP BY source) d ON g.source = d.source""".replace("GROUP BY ALL,\n      id", "GROUP BY source, id"),
    uses=("gaps",),
)
def profile_sources(spark, sf):
    return profile(stored_view(spark, sf, "gaps"), ["source"])


@query(
    "structure_report",
    "\nUNION ALL\n".join(
        f"""SELECT '{b}' AS source, count(*) AS rows, {len(raw_names(b))} AS columns,
          {_missing_total(raw_names(b))} AS total_missing,
          {f"'{t}'" if (t := {'Canada': 'overall_satisfaction', 'France': 'satisfaction_globale'}.get(b)) else 'CAST(NULL AS VARCHAR)'} AS target_column,
          CAST(0 AS BIGINT) AS duplicate_rows FROM raw_{b.lower()}"""
        for b in BRANCHES
    ),
    uses=_RAW_VIEWS,
)
def structure_report_query(spark, sf):
    report = structure_report(raw_sources(spark, sf))
    return report.select("source", "rows", "columns", "total_missing", "target_column", "duplicate_rows")


@query(
    "duplicate_rows",
    """SELECT 'documents' AS source, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicate_rows
    FROM documents""",
)
def duplicate_rows_query(spark, sf):
    """Whole rows but for their number."""
    documents = table(spark, sf, "documents").drop("doc_id").withColumnRenamed("source", "origin")
    return duplicate_rows({"documents": documents})


@query(
    "duplicate_events",
    "SELECT source, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT event_type AS source, user_id, count(*) AS n "
    "FROM events GROUP BY ALL) GROUP BY source",
)
def duplicate_events(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("source"), "user_id")
    return duplicate_rows(events, ["source"])


@query(
    "compare_missing",
    f"""SELECT source, CAST({_missing_total(_GAP_COLUMNS)} AS BIGINT) AS missing_before,
      CAST({_missing_total(("priority",))} AS BIGINT) AS missing_after,
      CAST({_missing_total(("price", "balance"))} AS BIGINT) AS missing_removed FROM gaps GROUP BY source""",
    uses=("gaps",),
)
def compare_missing_query(spark, sf):
    gaps = stored_view(spark, sf, "gaps")
    stats = imputation_stats(gaps, ["source"], ["price", "balance"])
    filled = impute_numeric(gaps, stats, ["source"], ["price", "balance"])
    return compare_missing(gaps, filled, ["source"])


def _corr_sql(view_name: str, target: str, columns, source: str = "source") -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT {source} AS source, '{target}' AS target, '{c}' AS variable,
              CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) END AS pearson_r,
              CASE WHEN isnan(r) THEN NULL ELSE round(abs(r), 6) END AS abs_r, n_valid FROM (
              SELECT {source} AS source, corr({c}, {target}) AS r, count(*) FILTER ({c} IS NOT NULL AND {target} IS NOT NULL) AS n_valid
              FROM {view_name} GROUP BY 1)"""
        )
    return "\nUNION ALL\n".join(parts)


def _rounded(found):
    return found.withColumns({"pearson_r": F.round("pearson_r", 6), "abs_r": F.round("abs_r", 6)})


@query(
    "correlations",
    _corr_sql("lines", "satisfaction", [c for c in _LINE_COLUMNS if c not in ("satisfaction", "linestatus")]),
    uses=("lines",),
)
def correlations_query(spark, sf):
    return _rounded(correlations(view(spark, sf, "lines"), ["source"]))


_NUMERIC = {
    "France": ["poids_kg", "prix_livraison_eur", "delai_livraison", "relation_livreur", "etat_colis", "service_client"],
    "Canada": ["poids_kg", "prix_livraison_eur", "delivery_time", "delivery_person", "parcel_condition", "customer_service"],
}
RAW_CORRELATIONS = "\nUNION ALL\n".join(
    _corr_sql(f"raw_{b.lower()}", t, _NUMERIC[b], f"'{b}'")
    for b, t in (("France", "satisfaction_globale"), ("Canada", "overall_satisfaction"))
)


@query("correlations_unlike_sources", RAW_CORRELATIONS, uses=("raw_france", "raw_canada"))
def correlations_unlike_sources(spark, sf):
    return _rounded(correlations(raw_sources(spark, sf)))


@query(
    "prune_weak_columns",
    f"""SELECT *, CAST(0.2 AS DOUBLE) AS threshold, 'Pearson |r| < 0.2: faible correlation avec le target.' AS justification
    FROM ({RAW_CORRELATIONS}) WHERE abs_r < 0.2 AND variable NOT IN ('taille_colis', 'fragile', 'poids_kg', 'prix_livraison_eur', 'statut_colis')""",
    uses=("raw_france", "raw_canada"),
)
def prune_weak_columns(spark, sf):
    return weak_columns(_rounded(correlations(raw_sources(spark, sf))))


@query(
    "low_correlation_candidates",
    f"SELECT * FROM ({RAW_CORRELATIONS}) WHERE abs_r < 0.2 ORDER BY abs_r, source, variable LIMIT 40",
    uses=("raw_france", "raw_canada"),
)
def low_correlation_candidates_query(spark, sf):
    return low_correlation_candidates(_rounded(correlations(raw_sources(spark, sf))))


def bounds_sql(view_name: str, columns, source: str = "source") -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT {source} AS source, '{c}' AS "column", {c} AS v,
              quantile_cont({c}, 0.25) OVER (PARTITION BY {source}) AS q1,
              quantile_cont({c}, 0.75) OVER (PARTITION BY {source}) AS q3 FROM {view_name} WHERE {c} IS NOT NULL"""
        )
    return "\nUNION ALL\n".join(parts)


OUTLIER_SQL = """SELECT source, "column", count(*) AS valid_count, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count,
    round(count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*) * 100, 2) AS outlier_rate_pct,
    round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr,
    round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper_bound
  FROM ({rows}) GROUP BY source, "column" """


def _round_bounds(report):
    return report.withColumns({c: F.round(c, 6) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")})


@query(
    "outlier_report",
    OUTLIER_SQL.replace("{rows}", bounds_sql("gaps", ["price", "balance", "rating"])),
    uses=("gaps",),
)
def outlier_report_query(spark, sf):
    return _round_bounds(outlier_report(stored_view(spark, sf, "gaps"), ["source"], ["price", "balance", "rating"]))


@query(
    "outlier_report_large_groups",
    OUTLIER_SQL.replace("{rows}", bounds_sql("lines", ["quantity", "satisfaction", "discount"])),
    uses=("lines",),
)
def outlier_report_large_groups(spark, sf):
    """The same report by counting passes, as groups too large for one task would take."""
    report = outlier_report(
        view(spark, sf, "lines"), ["source"], ["quantity", "satisfaction", "discount"], direct_values=2_000
    )
    return _round_bounds(report)


# --- Cleaning ----------------------------------------------------------------------------------

_FILLS = """SELECT source, 'price' AS "column", round((count(*) - count(price)) / count(*) * 100, 2) AS missing_rate_before_pct,
    count(*) - count(price) AS missing_before, 'median' AS method, round(median(price), 6) AS imputation_value FROM gaps GROUP BY source
  UNION ALL SELECT source, 'balance', round((count(*) - count(balance)) / count(*) * 100, 2),
    count(*) - count(balance), 'mean', round(avg(balance), 6) FROM gaps GROUP BY source
  UNION ALL SELECT source, 'rating', 0, 0, 'no_missing', NULL FROM gaps GROUP BY source"""


@query(
    "imputation_log",
    f"SELECT *, CAST(0 AS BIGINT) AS missing_after FROM ({_FILLS})",
    uses=("gaps",),
)
def imputation_log_query(spark, sf):
    stats = imputation_stats(stored_view(spark, sf, "gaps"), ["source"], ["price", "balance", "rating"])
    return imputation_log(stats).withColumn("imputation_value", F.round("imputation_value", 6))


@query(
    "impute_numeric",
    """SELECT id, round(coalesce(price, median(price) OVER (PARTITION BY source)), 6) AS price,
      round(coalesce(balance, avg(balance) OVER (PARTITION BY source)), 6) AS balance FROM gaps""",
    uses=("gaps",),
)
def impute_numeric_query(spark, sf):
    gaps = stored_view(spark, sf, "gaps")
    stats = imputation_stats(gaps, ["source"], ["price", "balance"])
    filled = impute_numeric(gaps, stats, ["source"], ["price", "balance"])
    return filled.select("id", F.round("price", 6).alias("price"), F.round("balance", 6).alias("balance"))


_MODES = """SELECT source, priority AS mode FROM (SELECT source, priority, row_number() OVER (PARTITION BY source
    ORDER BY count(*) DESC, priority) AS r FROM gaps WHERE priority IS NOT NULL GROUP BY source, priority) WHERE r = 1"""


@query(
    "fill_categories",
    f"SELECT id, coalesce(priority, mode) AS priority, status FROM gaps LEFT JOIN ({_MODES}) USING (source)",
    uses=("gaps",),
)
def fill_categories_query(spark, sf):
    gaps = stored_view(spark, sf, "gaps")
    columns = ["priority", "status"]
    filled = fill_categories(gaps, category_stats(gaps, ["source"], columns), ["source"], columns)
    return filled.select("id", "priority", "status")


@query(
    "category_fill_stats",
    f"""SELECT g.source, 'priority' AS "column", count(*) - count(priority) AS missing_count, any_value(mode) AS replacement
    FROM gaps g JOIN ({_MODES}) m ON g.source = m.source GROUP BY g.source""",
    uses=("gaps",),
)
def category_fill_stats(spark, sf):
    return category_stats(stored_view(spark, sf, "gaps"), ["source"], ["priority", "status"])


@query(
    "cap_outliers",
    """SELECT id, round(CASE WHEN price IS NULL THEN NULL ELSE least(greatest(price, p1 - 1.5 * (p3 - p1)), p3 + 1.5 * (p3 - p1)) END, 6) AS price,
      round(CASE WHEN balance IS NULL THEN NULL ELSE least(greatest(balance, b1 - 1.5 * (b3 - b1)), b3 + 1.5 * (b3 - b1)) END, 6) AS balance
    FROM gaps JOIN (SELECT source, quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3,
      quantile_cont(balance, 0.25) AS b1, quantile_cont(balance, 0.75) AS b3 FROM gaps GROUP BY source) USING (source)""",
    uses=("gaps",),
)
def cap_outliers_query(spark, sf):
    gaps = stored_view(spark, sf, "gaps")
    columns = ["price", "balance"]
    capped = cap_outliers(gaps, outlier_report(gaps, ["source"], columns), ["source"], columns)
    return capped.select("id", F.round("price", 6).alias("price"), F.round("balance", 6).alias("balance"))


@query(
    "correction_log",
    f"""SELECT g.source, 'priority' AS "column", 'missing_categorical' AS issue, count(*) - count(priority) AS count_before,
      count(*) - count(priority) AS count_corrected, 'mode' AS method, any_value(mode) AS value
    FROM gaps g JOIN ({_MODES}) m ON g.source = m.source GROUP BY g.source
    UNION ALL SELECT source, "column", 'numeric_outlier', outlier_count, outlier_count, 'clip_iqr_bounds',
      '[' || printf('%.4f', lower_bound) || ', ' || printf('%.4f', upper_bound) || ']' FROM ({OUTLIER_SQL.replace("{rows}", bounds_sql("gaps", ["price", "balance"]))}) WHERE outlier_count > 0""",
    uses=("gaps",),
)
def correction_log_query(spark, sf):
    gaps = stored_view(spark, sf, "gaps")
    log = correction_log(
        category_stats(gaps, ["source"], ["priority", "status"]),
        outlier_report(gaps, ["source"], ["price", "balance"]),
        ["source"],
    )
    # The last digits of a bound depend on the order of the arithmetic; four places are compared.
    ends = F.transform(F.split(F.regexp_replace("value", r"[\[\]]", ""), ", "), lambda x: x.try_cast("double"))
    printed = F.format_string("[%.4f, %.4f]", F.get(ends, F.lit(0)), F.get(ends, F.lit(1)))
    return log.withColumn("value", F.when(F.col("issue") == "numeric_outlier", printed).otherwise(F.col("value")))


# --- Normalized profiles --------------------------------------------------------------------------

_NORM_COLUMNS = [c for c in presets.FINAL_COLUMNS]
_CLAIM_COLUMNS = [
    "colis_id", "date_reclamation", "code_produit_global", "pays", "categorie_reclamation", "statut_reclamation",
    "priorite_traitement", "canal_reclamation", "sla_respecte", "produit_global",
]


@query(
    "normalized_profiles",
    f"""SELECT source_id AS id, any_value(source) AS source, 'satisfaction' AS kind, true AS available, count(*) AS rows, 12 AS columns,
      CAST(0 AS BIGINT) AS duplicate_rows, {_missing_total(_NORM_COLUMNS)} AS total_missing,
      round(({_missing_total(_NORM_COLUMNS)}) / (count(*) * 12) * 100, 2) AS missing_rate_pct FROM norm GROUP BY source_id
    UNION ALL SELECT 'reclamations', 'Réclamations', 'reclamations', true, count(*), 10, 0, {_missing_total(_CLAIM_COLUMNS)},
      round(({_missing_total(_CLAIM_COLUMNS)}) / (count(*) * 10) * 100, 2) FROM claim""",
    uses=("norm", "claim"),
)
def normalized_profiles_query(spark, sf):
    described, _ = normalized_profiles(source_set(spark, sf))
    return described.drop("error")


@query(
    "top_missing_columns",
    f"""SELECT source, "column", missing_count FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY missing_count DESC, "column") AS r
    FROM ({missing_sql("norm", _NORM_COLUMNS, "source_id")} UNION ALL {missing_sql("claim", _CLAIM_COLUMNS, "'reclamations'")})) WHERE r <= 12""",
    uses=("norm", "claim"),
)
def top_missing_columns(spark, sf):
    _, top = normalized_profiles(source_set(spark, sf))
    return top.select("source", "column", "missing_count")


@query(
    "claims_by_filter_values",
    "SELECT colis_id FROM claim WHERE lower(trim(canal_reclamation)) = 'web' AND lower(trim(statut_reclamation)) IN ('close')",
    uses=("claim",),
)
def claims_by_filter_values(spark, sf):
    spec = FilterSpec(values={"canal_reclamation": ["WEB"], "statut_reclamation": ["close "]}, score_min=4)
    return apply_filters(claim_rows(spark, sf), spec).select("colis_id")

"""The registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe import presets
from workload.views import BRANCHES, view_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the views its SQL reads."""

    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql, *uses)
        return fn

    return register


def with_views(body: str, *names: str) -> str:
    """The body with the views it uses in front, each defined once."""
    if not names:
        return body
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in DERIVED_NEEDS.get(name, ()):
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    defined = [f"{n} AS ({DERIVED[n] if n in DERIVED else view_sql(n)})" for n in ordered]
    return "WITH " + ",\n".join(defined) + "\n" + body


# --- SQL pieces ----------------------------------------------------------------------


def fold_sql(column: str) -> str:
    return f"coalesce(strip_accents(lower({column})), '')"


def lexicon_sql(column: str) -> str:
    text = fold_sql(column)

    def phrases(name: str) -> str:
        return "(" + " OR ".join(f"contains({text}, '{p}')" for p in presets.LEXICON[name]) + ")"

    def hits(name: str) -> str:
        return "(" + " + ".join(
            f"CAST(regexp_matches({text}, '\\b{w}\\b') AS INT)" for w in presets.LEXICON[name]
        ) + ")"

    return f"""CASE WHEN {column} IS NULL THEN NULL WHEN {phrases('strong_positive')} THEN 5.0
      WHEN {phrases('strong_negative')} THEN 1.0 WHEN {hits('negative')} >= 2 THEN 2.0
      WHEN {hits('negative')} > 0 AND {hits('positive')} > 0 THEN 3.0
      WHEN {hits('negative')} > 0 THEN 2.0 WHEN {hits('positive')} > 0 THEN 4.0 ELSE 3.0 END"""


def tokens_sql(text: str) -> str:
    return f"list_distinct(regexp_extract_all({fold_sql(text)}, '[a-z0-9]+'))"


def query_tokens_sql(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in presets.STOP_WORDS)
    return f"list_filter({tokens_sql(text)}, lambda w: length(w) > 2 AND w NOT IN ({stops}))"


def product_sql(branch: str, column: str) -> str:
    arms = " ".join(
        f"WHEN '{code}' THEN '{product}'"
        for code, product in presets.PRODUCT_CODES[branch].items()
    )
    return f"CASE {column} {arms} END"


CLAIM_PRODUCT_SQL = (
    "coalesce(CASE upper(code_produit_global) "
    + " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in presets.CLAIM_PRODUCTS.items())
    + " END, nullif(regexp_extract(code_produit_global, '(STANDARD|EXPRESS|PREMIUM)', 1), ''))"
)
SLA_SQL = "coalesce(lower(sla_respecte) IN ('oui', 'yes', 'true', '1'), false)"

RAW_SCORE = {
    "France": "satisfaction_globale",
    "Allemagne": "try_cast(gesamtzufriedenheit AS DOUBLE)",
    "Espagne": "CASE satisfaccion_global WHEN 'Bajo' THEN 1.0 WHEN 'Medio' THEN 3.0 WHEN 'Alto' THEN 5.0 END",
    "Canada": "overall_satisfaction / 2",
    "Maroc": lexicon_sql("commentaire_global"),
}


def normalized_sql(branch: str, raw: str | None = None) -> str:
    local = {canonical: name for name, canonical in presets.COLUMN_MAPS[branch].items()}
    score = f"CAST({RAW_SCORE[branch]} AS DOUBLE)"
    comment = "commentaire_global" if branch == "Maroc" else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{branch.lower()}' AS source_id, '{branch}' AS source,
      {local['id_enquete']} AS id_unique, {local['date_enquete']} AS date_enquete, '{branch}' AS pays,
      {local['code_produit']} AS code_produit,
      {product_sql(branch, local['code_produit'])} AS produit_global,
      taille_colis, fragile, poids_kg, prix_livraison_eur, statut_colis,
      CASE WHEN {score} BETWEEN 1 AND 5 THEN {score} END AS satisfaction_normalisee,
      {comment} AS commentaire_global
    FROM {raw or 'raw_' + branch.lower()}"""


NUMERIC_DETAILS = ("delai_livraison", "relation_livreur", "etat_colis", "service_client")
COUNTRY_AS_WRITTEN = {"Allemagne": "Deutschland", "Espagne": "España"}


def _standardized(branch: str) -> str:
    local = {canonical: name for name, canonical in presets.COLUMN_MAPS[branch].items()}
    cells = [f"'{branch}' AS source"]
    for name, dtype in presets.CANONICAL_COLUMNS.items():
        if name == "pays":
            cell = f"'{COUNTRY_AS_WRITTEN.get(branch, branch)}'"
        elif name in local:
            cell = f"CAST({local[name]} AS VARCHAR)" if name == "satisfaction_globale" else local[name]
        else:
            number = dtype == "double" or name in NUMERIC_DETAILS
            cell = f"CAST(NULL AS {'DOUBLE' if number else 'VARCHAR'})"
        cells.append(f"{cell} AS {name}")
    return "SELECT " + ", ".join(cells) + f" FROM raw_{branch.lower()}"


DERIVED = {
    "norm": "\nUNION ALL\n".join(normalized_sql(b) for b in BRANCHES),
    "standard": "\nUNION ALL\n".join(_standardized(b) for b in BRANCHES),
    "claim": f"SELECT *, {CLAIM_PRODUCT_SQL} AS produit_global FROM claims",
}
_ALL_RAW = tuple(f"raw_{b.lower()}" for b in BRANCHES)
DERIVED_NEEDS = {"norm": _ALL_RAW, "standard": _ALL_RAW, "claim": ("claims",)}

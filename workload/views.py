"""Views on the test tables that look like the sources of the five-branch preset.

Each view is one SQL text that Spark and DuckDB both run. A market segment plays a branch;
every branch has its own column names, product codes and score scale, and gaps, outliers,
bad scores and padded names are put in by fixed arithmetic on the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe import presets
from tallyframe.session import materialize

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Branch: segment, id prefix, country as written, product codes for status F, O, P.
BRANCHES = {
    "France": ("MACHINERY", "FR", " France "),
    "Espagne": ("AUTOMOBILE", "ES", "España"),
    "Maroc": ("HOUSEHOLD", "MA", "Maroc"),
    "Allemagne": ("FURNITURE", "DE", "Deutschland "),
    "Canada": ("BUILDING", "CA", "Canada"),
}

_SCORES = {
    "France": "CASE WHEN o_orderkey % 17 = 0 THEN 9.0D WHEN o_orderkey % 19 = 0 THEN NULL "
    "ELSE CAST((o_orderkey * 7) % 5 + 1 AS DOUBLE) END",
    "Allemagne": "CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE substr(o_orderpriority, 1, 1) END",
    "Espagne": "CASE o_orderkey % 5 WHEN 0 THEN 'Bajo' WHEN 1 THEN 'Medio' WHEN 2 THEN 'Alto' "
    "WHEN 3 THEN 'alto' ELSE NULL END",
    "Canada": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 11 AS DOUBLE) END",
}

_COMMENT = """CASE o_orderkey % 9
    WHEN 0 THEN 'Tout était PARFAIT, merci'
    WHEN 1 THEN 'Très insatisfait du colis'
    WHEN 2 THEN 'Retard et colis endommagé'
    WHEN 3 THEN 'Livreur professionnel mais retard'
    WHEN 4 THEN 'Un problème de suivi'
    WHEN 5 THEN 'Service rapide'
    WHEN 6 THEN 'Cliente satisfaite'
    WHEN 7 THEN 'insatisfait'
    ELSE NULL END"""


def _raw(branch: str) -> str:
    segment, prefix, country = BRANCHES[branch]
    standard, express, premium = presets.PRODUCT_CODES[branch]
    cells = {
        "id_enquete": f"concat('{prefix}-', lpad(CAST(o_orderkey AS STRING), 12, '0'))",
        "date_enquete": "o_orderdate",
        "pays": f"'{country}'",
        "code_produit": f"CASE o_orderstatus WHEN 'F' THEN '{standard}' WHEN 'O' THEN '{express}' "
        f"ELSE '{premium}' END",
        "taille_colis": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE substr(o_orderpriority, 3) END",
        "fragile": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Oui' WHEN 2 THEN ' oui ' ELSE 'Non' END",
        "poids_kg": "CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 101 = 0 "
        "THEN c_acctbal * 20 ELSE c_acctbal END",
        "prix_livraison_eur": "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 101 = 0 "
        "THEN o_totalprice * 10 ELSE o_totalprice END",
        "statut_colis": "CASE o_orderstatus WHEN 'F' THEN 'livre' WHEN 'O' THEN 'en cours' ELSE 'retour' END",
        "delai_livraison": "CAST(20 - o_orderkey % 11 + o_orderkey % 3 AS DOUBLE)",
        "relation_livreur": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey % 4 + 1 AS DOUBLE) END",
        "etat_colis": "CAST((o_orderkey * 7) % 5 + o_orderkey % 2 AS DOUBLE)",
        "service_client": "CAST(3 AS DOUBLE)",
        "satisfaction_globale": _SCORES.get(branch),
        "commentaire_global": _COMMENT,
    }
    local = {canonical: name for name, canonical in presets.COLUMN_MAPS[branch].items()}
    columns = [f"{cells[c]} AS {local[c]}" for c in presets.CANONICAL_COLUMNS if c in local]
    return (
        "SELECT " + ",\n  ".join(columns)
        + f"\nFROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey WHERE c_mktsegment = '{segment}'"
    )


RAW = {branch: _raw(branch) for branch in BRANCHES}

CLAIMS = """SELECT concat('COL-', lpad(CAST(event_id AS STRING), 12, '0')) AS colis_id,
  ts AS date_reclamation,
  CASE event_id % 6 WHEN 0 THEN 'COLIS_EXPRESS' WHEN 1 THEN 'colis_standard' WHEN 2 THEN 'X_PREMIUM_9'
    WHEN 3 THEN 'x_premium_9' WHEN 4 THEN 'Premium' ELSE NULL END AS code_produit_global,
  CASE user_id % 5 WHEN 0 THEN 'France' WHEN 1 THEN 'Espagne' WHEN 2 THEN 'Maroc'
    WHEN 3 THEN 'Allemagne' ELSE 'Italie' END AS pays,
  event_type AS categorie_reclamation,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'Ouverte' ELSE ' close' END AS statut_reclamation,
  CASE user_id % 3 WHEN 0 THEN 'haute' WHEN 1 THEN 'basse' ELSE 'normale' END AS priorite_traitement,
  CASE event_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'telephone' ELSE 'Web ' END AS canal_reclamation,
  CASE event_id % 5 WHEN 0 THEN 'Oui' WHEN 1 THEN 'yes' WHEN 2 THEN 'non' WHEN 3 THEN ' oui' ELSE NULL END AS sla_respecte
FROM {events}"""

QUESTIONS = """SELECT conv_id * 1000 + turn AS question_id,
  CASE conv_id % 6
    WHEN 0 THEN 'Compare la France et le Maroc.'
    WHEN 1 THEN 'Quelle est la satisfaction moyenne ?'
    WHEN 2 THEN 'Quelles sont les principales réclamations en Allemagne ?'
    WHEN 3 THEN 'Les clients français et espagnols'
    WHEN 4 THEN 'Claims in Canada'
    ELSE text END AS question,
  CASE conv_id % 5 WHEN 0 THEN 'espagne,france,maroc' WHEN 1 THEN 'france' WHEN 2 THEN 'canada,unknown'
    WHEN 3 THEN 'allemagne,reclamations' ELSE '' END AS selected_text
FROM {conversations} WHERE role = 'user'"""

# One table with a source column, a text gap, numeric gaps on both sides of five percent,
# and outliers; used by the operators that work on one table of several sources.
GAPS = """SELECT o_orderkey AS id, c_mktsegment AS source,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN c_acctbal * 20 ELSE c_acctbal END AS balance,
  CAST(o_orderkey % 11 AS DOUBLE) AS rating,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  o_orderstatus AS status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

LINES = """SELECT l_returnflag AS source, l_orderkey, l_linenumber,
  CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN (l_orderkey + l_linenumber) % 37 = 0 THEN NULL ELSE l_extendedprice END AS satisfaction,
  l_discount AS discount, l_tax AS tax, CAST(1 AS DOUBLE) AS constant, l_linestatus AS linestatus
FROM {lineitem}"""

VIEWS = {
    **{f"raw_{branch.lower()}": text for branch, text in RAW.items()},
    "claims": CLAIMS,
    "questions": QUESTIONS,
    "gaps": GAPS,
    "lines": LINES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a Spark DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def stored_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view that is read several times: joined once and written, its tables shuffled.

    As a lazy join every read would collect the smaller table in the driver to broadcast it again.
    """
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t).hint("merge") for t in TABLES if "{" + t + "}" in text}
    return materialize(spark.sql(text, **used), name)


def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {branch: view(spark, sf_dir, f"raw_{branch.lower()}") for branch in BRANCHES}


def view_sql(name: str) -> str:
    """A view as plain SQL over tables of their own names."""
    return VIEWS[name].format(**{t: t for t in TABLES}).replace("9.0D", "9.0::DOUBLE")

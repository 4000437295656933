"""Five-branch preset: schemas, code maps, lexicon, patterns and messages.

Everything here is data. The operators take these values as parameters, so another
set of branches is another module like this one.
"""

from __future__ import annotations

# --- Fixed values: column names of the two schemas -------------------------------

CANONICAL_COLUMNS = {
    "id_enquete": "string",
    "date_enquete": "timestamp",
    "pays": "string",
    "code_produit": "string",
    "taille_colis": "string",
    "fragile": "string",
    "poids_kg": "double",
    "prix_livraison_eur": "double",
    "statut_colis": "string",
    "delai_livraison": "string",
    "relation_livreur": "string",
    "etat_colis": "string",
    "service_client": "string",
    "satisfaction_globale": "string",
    "commentaire_global": "string",
}

FINAL_COLUMNS = {
    "id_unique": "string",
    "date_enquete": "timestamp",
    "pays": "string",
    "code_produit": "string",
    "produit_global": "string",
    "taille_colis": "string",
    "fragile": "string",
    "poids_kg": "double",
    "prix_livraison_eur": "double",
    "statut_colis": "string",
    "satisfaction_normalisee": "double",
    "commentaire_global": "string",
}

COLUMN_MAPS = {
    "Allemagne": {
        "umfrage_id": "id_enquete",
        "umfrage_datum": "date_enquete",
        "land": "pays",
        "produkt_code": "code_produit",
        "lieferzeit": "delai_livraison",
        "zusteller": "relation_livreur",
        "paket_zustand": "etat_colis",
        "kundenservice": "service_client",
        "gesamtzufriedenheit": "satisfaction_globale",
        "taille_colis": "taille_colis",
        "fragile": "fragile",
        "poids_kg": "poids_kg",
        "prix_livraison_eur": "prix_livraison_eur",
        "statut_colis": "statut_colis",
    },
    "Canada": {
        "survey_id": "id_enquete",
        "survey_date": "date_enquete",
        "country": "pays",
        "product_code": "code_produit",
        "delivery_time": "delai_livraison",
        "delivery_person": "relation_livreur",
        "parcel_condition": "etat_colis",
        "customer_service": "service_client",
        "overall_satisfaction": "satisfaction_globale",
        "taille_colis": "taille_colis",
        "fragile": "fragile",
        "poids_kg": "poids_kg",
        "prix_livraison_eur": "prix_livraison_eur",
        "statut_colis": "statut_colis",
    },
    "Espagne": {
        "id_encuesta": "id_enquete",
        "fecha_encuesta": "date_enquete",
        "pais": "pays",
        "producto": "code_produit",
        "plazo_entrega": "delai_livraison",
        "relacion_repartidor": "relation_livreur",
        "estado_paquete": "etat_colis",
        "servicio_cliente": "service_client",
        "satisfaccion_global": "satisfaction_globale",
        "taille_colis": "taille_colis",
        "fragile": "fragile",
        "poids_kg": "poids_kg",
        "prix_livraison_eur": "prix_livraison_eur",
        "statut_colis": "statut_colis",
    },
    "France": {
        "id_enquete": "id_enquete",
        "date_enquete": "date_enquete",
        "pays": "pays",
        "code_produit": "code_produit",
        "delai_livraison": "delai_livraison",
        "relation_livreur": "relation_livreur",
        "etat_colis": "etat_colis",
        "service_client": "service_client",
        "satisfaction_globale": "satisfaction_globale",
        "taille_colis": "taille_colis",
        "fragile": "fragile",
        "poids_kg": "poids_kg",
        "prix_livraison_eur": "prix_livraison_eur",
        "statut_colis": "statut_colis",
    },
    "Maroc": {
        "id_enquete": "id_enquete",
        "date_enquete": "date_enquete",
        "pays": "pays",
        "code_produit": "code_produit",
        "taille_colis": "taille_colis",
        "fragile": "fragile",
        "poids_kg": "poids_kg",
        "prix_livraison_eur": "prix_livraison_eur",
        "statut_colis": "statut_colis",
        "commentaire_global": "commentaire_global",
    },
}

# --- Fixed values: score column search and protected columns ----------------------

TARGET_ALIASES = (
    "rating",
    "overall_satisfaction",
    "satisfaction_globale",
    "satisfaction",
    "global_satisfaction",
)
PROTECTED_COLUMNS = (
    "taille_colis",
    "fragile",
    "poids_kg",
    "prix_livraison_eur",
    "statut_colis",
)

# --- Fixed values: product codes ---------------------------------------------------

PRODUCTS = ("STANDARD", "EXPRESS", "PREMIUM")
PRODUCT_CODES = {
    "France": {
        "COLIS_STANDARD": "STANDARD",
        "COLIS_EXPRESS": "EXPRESS",
        "COLIS_PREMIUM": "PREMIUM",
    },
    "Espagne": {
        "PAQUETE_ESTANDAR": "STANDARD",
        "PAQUETE_EXPRESS": "EXPRESS",
        "PAQUETE_PREMIUM": "PREMIUM",
    },
    "Canada": {
        "PARCEL_STANDARD": "STANDARD",
        "PARCEL_EXPRESS": "EXPRESS",
        "PARCEL_PREMIUM": "PREMIUM",
    },
    "Maroc": {
        "COLIS_STANDARD": "STANDARD",
        "COLIS_EXPRESS": "EXPRESS",
        "COLIS_PREMIUM": "PREMIUM",
    },
    "Allemagne": {
        "PAK_001": "STANDARD",
        "PAK_002": "EXPRESS",
        "PAK_003": "PREMIUM",
    },
}
COUNTRY_ALIASES = {"Deutschland": "Allemagne", "España": "Espagne"}
CLAIM_PRODUCTS = {
    "COLIS_STANDARD": "STANDARD",
    "COLIS_EXPRESS": "EXPRESS",
    "COLIS_PREMIUM": "PREMIUM",
    "STANDARD": "STANDARD",
    "EXPRESS": "EXPRESS",
    "PREMIUM": "PREMIUM",
}
CLAIM_PRODUCT_PATTERN = "(STANDARD|EXPRESS|PREMIUM)"

# --- Fixed values: score scales and comment lexicon --------------------------------

SCORE_RANGE = (1.0, 5.0)
SCORE_RULES = {
    "France": {"kind": "number", "column": "satisfaction_globale"},
    "Allemagne": {"kind": "number", "column": "satisfaction_globale"},
    "Canada": {"kind": "number", "column": "satisfaction_globale", "divide_by": 2.0},
    "Espagne": {
        "kind": "ordinal",
        "column": "satisfaction_globale",
        "levels": {"Bajo": 1.0, "Medio": 3.0, "Alto": 5.0},
    },
    "Maroc": {"kind": "lexicon", "column": "commentaire_global"},
}
LEXICON = {
    "strong_positive": ("tout etait parfait", "excellente experience", "pleinement satisfait"),
    "strong_negative": ("tres insatisfait", "tres insatisfaite", "experience decevante"),
    "positive": (
        "excellent", "parfait", "satisfait", "bonne", "bien", "rapide", "professionnel",
    ),
    "negative": (
        "insatisfaisant", "insatisfait", "decevant", "retard", "endommage", "probleme",
        "mauvais", "lent",
    ),
}

# --- Fixed values: filters, tokens, scope detection --------------------------------

FILTER_FIELDS = (
    "pays",
    "produit_global",
    "code_produit",
    "taille_colis",
    "statut_colis",
    "fragile",
    "categorie_reclamation",
    "statut_reclamation",
    "priorite_traitement",
    "canal_reclamation",
)
DATE_COLUMNS = ("date_enquete", "date_reclamation")
SCORE_COLUMN = "satisfaction_normalisee"
SLA_TRUE = ("oui", "yes", "true", "1")

STOP_WORDS = (
    "avec", "dans", "des", "est", "les", "leur", "mais", "mon", "pour",
    "que", "qui", "sur", "une", "vous", "the", "and", "for", "from",
    "how", "what", "when", "where", "which", "with", "about", "does",
)

SOURCE_PATTERNS = {
    "france": (r"\bfrance\b", r"\bfrancais\b", r"\bfrancaise\b"),
    "espagne": (r"\bespagne\b", r"\bspain\b", r"\bespagnol"),
    "maroc": (r"\bmaroc\b", r"\bmorocco\b", r"\bmarocain"),
    "allemagne": (r"\ballemagne\b", r"\bgermany\b", r"\ballemand"),
    "canada": (r"\bcanada\b", r"\bcanadien"),
    "reclamations": (r"\breclamation", r"\bplainte", r"\bclaims?\b", r"\breclams?\b"),
}
SOURCE_LABELS = {
    "france": "France",
    "espagne": "Espagne",
    "maroc": "Maroc",
    "allemagne": "Allemagne",
    "canada": "Canada",
    "reclamations": "Réclamations",
}
SURVEY_SOURCES = ("france", "espagne", "maroc", "allemagne", "canada")
CLAIM_SOURCES = ("reclamations",)

# --- Fixed values: message texts ----------------------------------------------------

MISSING_CATEGORY = "Non renseigne"
SCOPE_WARNING = (
    "La question mentionne %s alors que l'interface sélectionne %s. "
    "L'analyse utilise le périmètre explicitement demandé dans la question."
)
NO_ROW_JOIN = (
    "Les enquêtes utilisent id_unique (ex. FR-0001) alors que les réclamations utilisent "
    "colis_id (ex. COL-FR-00001). Aucune clé commune ne permet une jointure ligne à ligne. "
    "Seule une comparaison agrégée par pays / produit est possible."
)

# Indicators in display order: id, label, hint.
INDICATORS = (
    ("satisfaction", "Satisfaction moyenne", "notes valides"),
    ("responses", "Réponses", "Enquêtes de satisfaction du périmètre"),
    ("products", "Produits", "Produits globaux distincts"),
    ("claims", "Réclamations", "Lignes de la base réclamations filtrée"),
    ("rate", "Taux de satisfaction", "Part des notes ≥ 4 / 5"),
    ("sla", "SLA respecté", "Part des réclamations au SLA"),
)

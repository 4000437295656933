"""Product codes: the reference table, the lookup and its unmapped keys."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe import presets
from tallyframe.operators.attach import BROADCAST_BYTES, Lookup, attach, measure, require_unique
from tallyframe.operators.schema import canonical_country


def product_reference(
    spark: SparkSession,
    codes: Mapping[str, Mapping[str, str]] = presets.PRODUCT_CODES,
) -> DataFrame:
    """Country, local code and global product of a configured table."""
    rows = [
        (country, code, product)
        for country, local in codes.items()
        for code, product in local.items()
    ]
    return spark.createDataFrame(rows, "pays string, code_produit_source string, produit_global string")


KEYS = ("pays", "code_produit")


def product_lookup(reference: DataFrame) -> Lookup:
    """A reference table checked for repeated keys and measured for its join."""
    table = reference.select("pays", F.col("code_produit_source").alias("code_produit"), "produit_global")
    require_unique(table, KEYS)
    return measure(table, KEYS)


def preset_lookup(spark: SparkSession, codes: Mapping[str, Mapping[str, str]] = presets.PRODUCT_CODES) -> Lookup:
    """The lookup of a configured code table, which is local: its keys are known without a job."""
    table = product_reference(spark, codes).withColumnRenamed("code_produit_source", "code_produit")
    return Lookup(table, KEYS, len(json.dumps(codes)) <= BROADCAST_BYTES)


def add_product(
    df: DataFrame,
    lookup: Lookup,
    aliases: Mapping[str, str] = presets.COUNTRY_ALIASES,
) -> DataFrame:
    """Add ``produit_global`` by (country, code); the source code stays, misses are null."""
    named = df.withColumn("pays", canonical_country(F.col("pays"), aliases))
    return attach(named, lookup)


def unmapped_codes(
    df: DataFrame, country_column: str = "pays", code_column: str = "code_produit"
) -> DataFrame:
    """The distinct (country, code) pairs that found no product.

    The rows come from ``add_product``: its join has already marked them, so no second
    join is needed.
    """
    misses = df.filter(F.col("produit_global").isNull())
    return misses.select(country_column, code_column).distinct()


def require_mapped(df: DataFrame, country_column: str = "pays", code_column: str = "code_produit") -> None:
    offenders = unmapped_codes(df, country_column, code_column).collect()
    if offenders:
        raise ValueError(f"Codes produits non mappes: {[r.asDict() for r in offenders]}")

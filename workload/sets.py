"""The declared sources of the workload, built through the library's own operators.

Services read the normalized table that wrangling has written; they do not clean again. So
the table is written once per session and data folder, and queries on it read that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe import presets
from tallyframe.operators.products import preset_lookup, product_reference
from tallyframe.operators.schema import standardize_all
from tallyframe.plans.wrangle import normalize_all
from tallyframe.session import scratch_path
from tallyframe.sources.readers import SourceSet, SourceSpec, default_catalog
from tallyframe.sources.sinks import write_normalized
from workload.views import raw_sources, view

FINAL_SCHEMA = ", ".join(f"{name} {dtype}" for name, dtype in presets.FINAL_COLUMNS.items())
_WRITTEN: dict[tuple[str, str], str] = {}


def catalog() -> tuple[SourceSpec, ...]:
    return default_catalog("unused")


def normalized(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The normalized sources straight from the raw ones, as a lazy plan."""
    standard = standardize_all(raw_sources(spark, sf_dir))
    return normalize_all(standard, preset_lookup(spark))


def normalized_table(spark: SparkSession, sf_dir: str) -> str:
    """The path of the written normalized table, partitioned by source."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _, consolidated = normalized(spark, sf_dir)
        out = scratch_path(spark, "normalized")
        _WRITTEN[key] = write_normalized(consolidated, product_reference(spark), out)["table"]
    return _WRITTEN[key]


def survey_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = normalized_table(spark, sf_dir)
    return spark.read.schema(f"{FINAL_SCHEMA}, source string").parquet(path)


def source_set(spark: SparkSession, sf_dir: str) -> SourceSet:
    path = normalized_table(spark, sf_dir)
    frames = {
        source: spark.read.schema(FINAL_SCHEMA).parquet(f"{path}/source={presets.SOURCE_LABELS[source]}")
        for source in presets.SURVEY_SOURCES
    }
    frames["reclamations"] = view(spark, sf_dir, "claims")
    return SourceSet.of(catalog(), frames, check=False)


def claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_set(spark, sf_dir).frames["reclamations"]

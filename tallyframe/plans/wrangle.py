"""Raw surveys to one clean, normalized table with its reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tallyframe import presets
from tallyframe.functions.cast import without_nan
from tallyframe.functions.scoring import rule_score
from tallyframe.operators.clean import drop_weak, weak_columns
from tallyframe.operators.attach import Lookup
from tallyframe.operators.moments import Fitted
from tallyframe.operators.products import add_product, preset_lookup, product_reference, require_mapped
from tallyframe.operators.profile import SOURCE, compare_missing, structure_report
from tallyframe.operators.schema import select_final, standardize_all, union_tagged
from tallyframe.plans.fitting import fit_cleaning
from tallyframe.session import scratch_path
from tallyframe.sources.sinks import write_normalized


@dataclass(frozen=True)
class Preset:
    """The configuration of a set of branches."""

    column_maps: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: presets.COLUMN_MAPS)
    canonical: Mapping[str, str] = field(default_factory=lambda: presets.CANONICAL_COLUMNS)
    final: Mapping[str, str] = field(default_factory=lambda: presets.FINAL_COLUMNS)
    score_rules: Mapping[str, Mapping[str, object]] = field(default_factory=lambda: presets.SCORE_RULES)
    lexicon: Mapping[str, Sequence[str]] = field(default_factory=lambda: presets.LEXICON)
    score_range: tuple[float, float] = presets.SCORE_RANGE
    protected: Sequence[str] = presets.PROTECTED_COLUMNS
    aliases: Sequence[str] = presets.TARGET_ALIASES
    correlation_threshold: float = 0.2
    outlier_multiplier: float = 1.5


@dataclass(frozen=True)
class Wrangled:
    """The normalized rows, what cleaning did, and the inputs of its stages.

    ``logs`` were needed to clean and are at hand. The profiles of the raw data are built on
    demand, as they cost passes of their own.
    """

    tables: dict[str, DataFrame]
    consolidated: DataFrame
    logs: dict[str, DataFrame]
    raw: dict[str, DataFrame]
    pruned: dict[str, DataFrame]
    imputed: dict[str, DataFrame]
    preset: Preset
    fitted: Fitted

    def structure(self) -> DataFrame:
        return structure_report(self.raw, aliases=self.preset.aliases)

    def missing(self) -> DataFrame:
        return self.fitted.missing_report()

    def missing_comparison(self) -> DataFrame:
        return compare_missing(self.pruned, self.imputed)


def normalize(source: str, df: DataFrame, products: Lookup, preset: Preset = Preset()) -> DataFrame:
    """One standardized source in the final schema: product, score, identifier."""
    if source not in preset.score_rules:
        raise ValueError(f"Pays non supporte: {source}")
    rule = preset.score_rules[source]
    dtype = df.schema[rule["column"]].dataType
    scored = add_product(df, products).withColumn(
        presets.SCORE_COLUMN, rule_score(rule, dtype, preset.score_range, preset.lexicon)
    )
    return select_final(scored, preset.final)


def normalize_all(frames: Mapping[str, DataFrame], products: Lookup, preset: Preset = Preset()) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every source in the final schema, and their union with a ``source`` column."""
    tables = {source: normalize(source, df, products, preset) for source, df in frames.items()}
    return tables, union_tagged(tables, SOURCE)


def normalization_audit(consolidated: DataFrame, n_columns: int, score: str = presets.SCORE_COLUMN) -> DataFrame:
    """Rows, columns, scored rows and rows without product per source, in one pass."""
    return consolidated.groupBy(SOURCE).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(n_columns).alias("columns"),
        F.count(score).alias("scored"),
        F.count_if(F.col("produit_global").isNull()).alias("unmapped"),
    )


def check_row_counts(before: Mapping[str, DataFrame] | int, audit: DataFrame) -> None:
    """Rows in must be rows out; compares two counts. The first one is given or counted."""
    rows_in = before if isinstance(before, int) else sum(df.count() for df in before.values())
    rows_out = audit.agg(F.sum("rows")).first()[0] or 0
    if rows_in != rows_out:
        raise ValueError(f"row count changed from {rows_in} to {rows_out}")


def wrangle(
    frames: Mapping[str, DataFrame],
    preset: Preset = Preset(),
    out: str | None = None,
    check: bool = True,
) -> Wrangled:
    """Profile, prune, impute, correct, standardize, normalize and write the raw sources.

    The score itself is imputed and capped before its scale is unified, and missing comments
    take the most frequent one: cleaning treats every column of its type alike. The final
    table is written to the shared folder, partitioned by source; the guards and all readers
    use what was written there. Only after the guards is it published below ``out``. The raw
    rows are read four times: for moments, order statistics, tallies, and to be written.
    """
    raw = {source: without_nan(df) for source, df in frames.items()}
    spark = next(iter(raw.values())).sparkSession
    fitted = Fitted.of(raw, aliases=preset.aliases)
    found = fitted.correlations()
    weak = weak_columns(found, preset.correlation_threshold, preset.protected)
    pruned = drop_weak(raw, weak)
    cleaned = fit_cleaning(pruned, fitted, multiplier=preset.outlier_multiplier)

    # A pruned column is absent from its source and comes back as null here.
    standard = standardize_all(cleaned.corrected, preset.column_maps, preset.canonical)
    _, consolidated = normalize_all(standard, preset_lookup(spark), preset)
    paths = write_normalized(
        consolidated, product_reference(spark), scratch_path(spark, "wrangled"), SOURCE, preset.score_range
    )
    consolidated = spark.read.schema(consolidated.schema).parquet(paths["table"])
    audit = normalization_audit(consolidated, len(preset.final))
    if check:
        require_mapped(consolidated)
        check_row_counts(sum(fitted.rows().values()), audit)
    if out:
        write_normalized(consolidated, product_reference(spark), out, SOURCE, preset.score_range)
    tables = {
        source: consolidated.filter(F.col(SOURCE) == source).drop(SOURCE) for source in frames
    }
    logs = {
        "correlations": found,
        "removed_columns": weak,
        "imputation": cleaned.imputation,
        "outliers": cleaned.outliers,
        "corrections": cleaned.corrections,
        "normalization": audit,
    }
    return Wrangled(tables, consolidated, logs, raw, pruned, cleaned.imputed, preset, fitted)

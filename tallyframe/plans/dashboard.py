"""Dashboard, table pages, export and source options over a set of sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tallyframe import presets
from tallyframe.functions.cast import ref
from tallyframe.operators.filters import FilterSpec, apply_to_all
from tallyframe.operators.metrics import (
    claim_cube,
    group_mean,
    indicators,
    monthly_count,
    monthly_mean,
    score_histogram,
    survey_cube,
    value_counts,
)
from tallyframe.operators.options import column_names, date_extent, filter_values
from tallyframe.operators.paging import DEFAULT_SIZE, Page, page
from tallyframe.operators.schema import align_union, split_by_kind, union_aligned, visible_columns
from tallyframe.session import materialize
from tallyframe.sources.readers import CLAIM_KIND, SURVEY_KIND, SourceSet
from tallyframe.sources.sinks import write_export

_NO_SURVEYS = f"{presets.SCORE_COLUMN} double"
_NO_CLAIMS = "sla_respecte string"


def filtered(sources: SourceSet, ids: Sequence[str], spec: FilterSpec) -> dict[str, DataFrame]:
    return apply_to_all(sources.pick(ids), spec)


def cubes(sources: SourceSet, frames: Mapping[str, DataFrame], extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The survey cube and the claim cube of the filtered sources, each from one scan.

    Both are small and written out: every series that follows reads them instead of the rows.
    """
    kinds = {source: sources.specs[source].kind for source in frames}
    groups = split_by_kind(frames, kinds)
    spark = next(iter(sources.frames.values())).sparkSession
    more = "".join(f", {name} string" for name in extra)
    surveys = groups.get(SURVEY_KIND)
    if surveys is None:
        surveys = spark.createDataFrame([], _NO_SURVEYS + more)
    claims = groups.get(CLAIM_KIND)
    if claims is None:
        claims = spark.createDataFrame([], _NO_CLAIMS + more)
    return (
        materialize(survey_cube(surveys, extra=extra), "survey-cube"),
        materialize(claim_cube(claims, extra=extra), "claim-cube"),
    )


def dashboard(sources: SourceSet, ids: Sequence[str], spec: FilterSpec = FilterSpec()) -> dict[str, DataFrame]:
    """Indicators, eight series, row counts and filter options for the chosen sources."""
    frames = filtered(sources, ids, spec)
    surveys, claims = cubes(sources, frames)
    claims_selected = any(sources.specs[i].kind == CLAIM_KIND for i in ids)
    unfiltered = sources.pick(ids)
    # A total without group key has a line also where there are no rows of a kind.
    total = F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
    counts = surveys.agg(total).select(F.lit("satisfaction_rows").alias("id"), "rows").unionByName(
        claims.agg(total).select(F.lit("claims_rows").alias("id"), "rows")
    )
    satisfaction, claimed = (F.sum(F.when(F.col("id") == name, F.col("rows"))) for name in ("satisfaction_rows", "claims_rows"))
    overview = counts.agg(
        F.sum("rows").alias("row_count"),
        (satisfaction > 0).alias("has_satisfaction"),
        (claimed > 0).alias("has_claims"),
    )
    return {
        "indicators": indicators(surveys, claims, claims_selected),
        "row_counts": counts,
        "overview": overview,
        "satisfaction_by_country": group_mean(surveys, "country", None),
        "satisfaction_by_product": group_mean(surveys, "product", None),
        "satisfaction_over_time": monthly_mean(surveys, "month", None),
        "score_distribution": score_histogram(surveys, "bucket"),
        "claims_by_category": value_counts(claims, "category"),
        "claims_by_country": value_counts(claims, "country"),
        "claims_over_time": monthly_count(claims, "month"),
        "claims_by_status": value_counts(claims, "status"),
        "option_values": filter_values(unfiltered),
        "option_dates": date_extent(unfiltered),
    }


def options(sources: SourceSet, ids: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Filter values, date extent and column names over the unfiltered sources."""
    frames = sources.pick(ids)
    return filter_values(frames), date_extent(frames), column_names(frames)


def _ordered_union(sources: SourceSet, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The combined table with the columns that stand for row order."""
    placed = [
        df.withColumns(
            {
                "_position": F.lit(position),
                "_key": ref(sources.specs[source].order_key).cast("string"),
            }
        )
        for position, (source, df) in enumerate(frames.items())
    ]
    return union_aligned(placed)


def table_page(
    sources: SourceSet,
    ids: Sequence[str],
    spec: FilterSpec = FilterSpec(),
    sort_by: str | None = None,
    descending: bool = False,
    number: int = 1,
    size: int = DEFAULT_SIZE,
) -> Page:
    """A page of the combined table; equal sort values keep source and key order."""
    combined = _ordered_union(sources, filtered(sources, ids, spec))
    shown = ["_source_label", "_kind", *visible_columns(combined)]
    found = page(
        combined.select(*[ref(c) for c in shown], "_position", "_key"),
        ["_position", "_key"],
        sort_by if sort_by in shown else None,
        descending,
        number,
        size,
    )
    return Page(found.rows.select(*[ref(c) for c in shown]), found.total, found.page, found.page_size, found.pages)


def combined_table(sources: SourceSet, ids: Sequence[str], spec: FilterSpec = FilterSpec()) -> DataFrame:
    return align_union(filtered(sources, ids, spec))


def export(sources: SourceSet, ids: Sequence[str], out: str, spec: FilterSpec = FilterSpec(), fmt: str = "csv") -> str:
    """Write every row of the filtered combined table."""
    return write_export(filtered(sources, ids, spec), out, fmt)

"""Schema operators: rename, align, combine, split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tallyframe import presets
from tallyframe.functions.cast import is_numeric, num_of, ref, without_nan
from tallyframe.functions.scoring import lookup
from tallyframe.functions.text import strip, value_text


def check_columns(source: str, columns: Sequence[str], maps: Mapping[str, Mapping[str, str]]) -> None:
    """The schema contract: every column of a known source must be mapped."""
    offenders = [name for _, name in contract_offenders({source: columns}, maps)]
    if offenders == [None]:
        raise ValueError(f"Mapping absent pour {source}")
    if offenders:
        raise ValueError(f"Colonnes non mappees pour {source}: {offenders}")


def contract_offenders(
    columns: Mapping[str, Sequence[str]], maps: Mapping[str, Mapping[str, str]] = presets.COLUMN_MAPS
) -> list[tuple[str, str | None]]:
    """(source, column) of every breach: unmapped columns, and a source without a map with no column."""
    unknown = [(source, None) for source in columns if source not in maps]
    unmapped = [(s, c) for s, names in columns.items() if s in maps for c in names if c not in maps[s]]
    return unknown + unmapped


def contract_report(
    frames: Mapping[str, DataFrame], maps: Mapping[str, Mapping[str, str]] = presets.COLUMN_MAPS
) -> DataFrame:
    """Every breach of the schema contract with the cells that are lost by it: source, column, rows, present.

    Where ``standardize`` stops at the first source, this names all offenders. A source without a map is one
    line without column. Only the offending columns are read; sources that keep the contract have no line.
    """
    parts = []
    found = contract_offenders({source: df.columns for source, df in frames.items()}, maps)
    for source in dict.fromkeys(s for s, _ in found):
        df, names = frames[source], [c for s, c in found if s == source]
        counts = [F.count(F.lit(1)).alias("_rows"), *[F.count(ref(c)).alias(f"_n{i}") for i, c in enumerate(names) if c is not None]]
        lines = [
            F.struct(
                F.lit(source).alias("source"),
                F.lit(name).cast("string").alias("column"),
                F.col("_rows").alias("rows"),
                (F.lit(None).cast("bigint") if name is None else F.col(f"_n{i}")).alias("present"),
            )
            for i, name in enumerate(names)
        ]
        parts.append(df.agg(*counts).select(F.inline(F.array(*lines))))
    if not parts:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], "source string, column string, rows bigint, present bigint")
    return reduce(DataFrame.unionByName, parts)


def standardize(
    source: str,
    df: DataFrame,
    maps: Mapping[str, Mapping[str, str]] = presets.COLUMN_MAPS,
    canonical: Mapping[str, str] = presets.CANONICAL_COLUMNS,
    country_column: str = "pays",
) -> DataFrame:
    """One source in the common schema: renamed, completed with nulls, in fixed order."""
    check_columns(source, df.columns, maps)
    local = {maps[source][name]: name for name in df.columns}
    projected = []
    for name, dtype in canonical.items():
        if name not in local:
            projected.append(F.lit(None).cast(dtype).alias(name))
        elif name == country_column:
            projected.append(strip(ref(local[name]).cast("string")).alias(name))
        else:
            projected.append(ref(local[name]).alias(name))
    return df.select(*projected)


def standardize_all(
    frames: Mapping[str, DataFrame],
    maps: Mapping[str, Mapping[str, str]] = presets.COLUMN_MAPS,
    canonical: Mapping[str, str] = presets.CANONICAL_COLUMNS,
) -> dict[str, DataFrame]:
    return {source: standardize(source, df, maps, canonical) for source, df in frames.items()}


def canonical_country(column, aliases: Mapping[str, str] = presets.COUNTRY_ALIASES):
    """The project's name of a country; names without an alias pass unchanged."""
    return F.coalesce(lookup(column, aliases), column)


def select_final(
    df: DataFrame,
    final: Mapping[str, str] = presets.FINAL_COLUMNS,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Cut to the final columns in order, cast to their types; absent ones are null."""
    origin = {"id_unique": "id_enquete", **(renames or {})}
    projected = []
    for name, dtype in final.items():
        source = name if name in df.columns else origin.get(name)
        if source not in df.columns:
            projected.append(F.lit(None).cast(dtype).alias(name))
        elif dtype == "double":
            projected.append(num_of(df, source).alias(name))
        elif dtype == "timestamp":
            projected.append(ref(source).try_cast(dtype).alias(name))
        else:
            projected.append(ref(source).cast(dtype).alias(name))
    return df.select(*projected)


def _common_type(types: list[T.DataType]) -> T.DataType | None:
    """One type for a column name, or None when only text can hold them all."""
    distinct = {t.simpleString(): t for t in types}
    if len(distinct) == 1:
        return types[0]
    kinds = list(distinct.values())
    if all(is_numeric(t) for t in kinds):
        whole = all(isinstance(t, T.IntegralType) for t in kinds)
        return T.LongType() if whole else T.DoubleType()
    stamps = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if all(isinstance(t, stamps) for t in kinds):
        return T.TimestampType()
    return None


def align_types(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """Give a column the same type in every frame, so that their union cannot fail."""
    seen: dict[str, list[T.DataType]] = {}
    for df in frames:
        for field in df.schema.fields:
            seen.setdefault(field.name, []).append(field.dataType)
    target = {name: _common_type(types) for name, types in seen.items()}

    def cell(field: T.StructField):
        wanted = target[field.name]
        if wanted is None:
            return value_text(ref(field.name), field.dataType).alias(field.name)
        if wanted == field.dataType:
            return ref(field.name)
        return ref(field.name).cast(wanted).alias(field.name)

    return [df.select(*[cell(f) for f in df.schema.fields]) for df in frames]


def union_aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of unlike schemas: common types first, absent columns null."""
    if not frames:
        raise ValueError("nothing to union")
    aligned = align_types(frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def align_union(frames: Mapping[str, DataFrame]) -> DataFrame:
    """The display table: source label and kind first, other lineage columns hidden."""
    combined = without_nan(union_aligned(list(frames.values())))
    lead = [name for name in ("_source_label", "_kind") if name in combined.columns]
    return combined.select(*[ref(c) for c in lead + visible_columns(combined)])


def visible_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if not name.startswith("_")]


def split_by_kind(
    frames: Mapping[str, DataFrame], kinds: Mapping[str, str]
) -> dict[str, DataFrame]:
    """One union per kind of source; a kind without sources is absent from the result."""
    groups: dict[str, list[DataFrame]] = {}
    for source, df in frames.items():
        groups.setdefault(kinds[source], []).append(df)
    return {kind: union_aligned(parts) for kind, parts in groups.items()}


def union_tagged(frames: Mapping[str, DataFrame], column: str = "source") -> DataFrame:
    """Union of the sources with their name as a column."""
    return union_aligned([df.withColumn(column, F.lit(name)) for name, df in frames.items()])

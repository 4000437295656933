"""Reading files into DataFrames by declared format."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyframe import presets
from tallyframe.functions.cast import ref, without_nan
from tallyframe.sources.tagging import tag_claims, tag_surveys

SURVEY_KIND = "satisfaction"
CLAIM_KIND = "reclamations"


@dataclass(frozen=True)
class SourceSpec:
    """One declared source. ``order_key`` is a unique column that stands for row order."""

    id: str
    label: str
    kind: str
    path: str
    country: str | None = None
    order_key: str | None = None


def default_catalog(root: str, suffix: str = "parquet") -> tuple[SourceSpec, ...]:
    """The six sources of the preset below one root folder."""
    surveys = tuple(
        SourceSpec(
            id=source,
            label=presets.SOURCE_LABELS[source],
            kind=SURVEY_KIND,
            path=f"{root}/{source}_normalisee.{suffix}",
            country=presets.SOURCE_LABELS[source],
            order_key="id_unique",
        )
        for source in presets.SURVEY_SOURCES
    )
    claims = tuple(
        SourceSpec(
            id=source,
            label=presets.SOURCE_LABELS[source],
            kind=CLAIM_KIND,
            path=f"{root}/{source}_curated.{suffix}",
            order_key="colis_id",
        )
        for source in presets.CLAIM_SOURCES
    )
    return surveys + claims


def _leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> Iterator[tuple[Column, str]]:
    for field in schema.fields:
        steps = (*prefix, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, steps)
        else:
            column = ref(steps[0])
            for step in steps[1:]:
                column = column.getField(step)
            yield column, ".".join(steps)


def flatten(df: DataFrame) -> DataFrame:
    """Nested records as top-level columns with dotted names; arrays stay arrays."""
    return df.select(*[column.alias(name) for column, name in _leaves(df.schema)])


def strip_labels(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Read by suffix: parquet, orc, csv, json (object or array per file) or jsonl.

    A ``json`` file is one document and cannot be split between tasks; large inputs
    belong in ``jsonl`` or Parquet. Without a schema, csv and json take one more pass to infer
    types. Labels are stripped. NaN in text formats becomes null; columnar files are left
    bare, so that filters reach the scan, and the operators read NaN as missing.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if suffix == "parquet":
        return strip_labels(reader.parquet(path))
    if suffix == "orc":
        return strip_labels(reader.orc(path))
    if suffix == "csv":
        df = reader.options(header=True, inferSchema=schema is None).csv(path)
    elif suffix == "json":
        df = flatten(reader.option("multiLine", True).json(path))
    elif suffix == "jsonl":
        df = flatten(reader.json(path))
    else:
        raise ValueError(f"Format non supporte: .{suffix}")
    return without_nan(strip_labels(df))


def read_tables(spark: SparkSession, paths: Mapping[str, str], **options: str) -> dict[str, DataFrame]:
    """Each declared file, lazily, under its source name."""
    return {name: read_table(spark, path, **options) for name, path in paths.items()}


def read_same_schema(spark: SparkSession, paths: Mapping[str, str], column: str = "source") -> DataFrame:
    """Several Parquet sources of one schema, each read and tagged on its own.

    The name goes with the read, not with the file's path, so any folder name will do.
    """
    tagged = [spark.read.parquet(path).withColumn(column, F.lit(source)) for source, path in paths.items()]
    return reduce(DataFrame.unionByName, tagged)


def tag(df: DataFrame, spec: SourceSpec) -> DataFrame:
    return tag_claims(df, spec) if spec.kind == CLAIM_KIND else tag_surveys(df, spec)


def _empty_message(spec: SourceSpec) -> str:
    name = spec.path.rstrip("/").rsplit("/", 1)[-1]
    return f"Le fichier {name} est vide."


def load_source(spark: SparkSession, spec: SourceSpec) -> tuple[DataFrame | None, str | None]:
    """The tagged rows, or the reason they cannot be had."""
    name = spec.path.rstrip("/").rsplit("/", 1)[-1]
    try:
        df = read_table(spark, spec.path)
        empty = df.isEmpty()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None, f"Fichier introuvable: {name}"
        return None, f"Impossible de lire {name}: {error.getCondition()}"
    except Exception as error:  # noqa: BLE001 - any read failure is a status, not a crash
        return None, f"Impossible de lire {name}: {type(error).__name__}"
    if empty:
        return None, _empty_message(spec)
    return tag(df, spec), None


@dataclass
class SourceSet:
    """The declared sources with their rows or their errors."""

    specs: dict[str, SourceSpec]
    frames: dict[str, DataFrame]
    errors: dict[str, str]

    @classmethod
    def load(cls, spark: SparkSession, specs: tuple[SourceSpec, ...]) -> SourceSet:
        frames, errors = {}, {}
        for spec in specs:
            df, error = load_source(spark, spec)
            if error is None:
                frames[spec.id] = df
            else:
                errors[spec.id] = error
        return cls({spec.id: spec for spec in specs}, frames, errors)

    @classmethod
    def of(cls, specs: tuple[SourceSpec, ...], frames: Mapping[str, DataFrame], check: bool = True) -> SourceSet:
        """From DataFrames at hand (tables, views or streams) instead of files.

        A table without rows is an error, as it is for a file; a stream is not asked. ``check=False``
        spares the look at the first row of tables that are known to have some.
        """
        errors = {}
        for spec in specs:
            if spec.id not in frames:
                errors[spec.id] = f"Source indisponible: {spec.id}"
            elif check and not frames[spec.id].isStreaming and frames[spec.id].isEmpty():
                errors[spec.id] = _empty_message(spec)
        kept = {spec.id: tag(frames[spec.id], spec) for spec in specs if spec.id not in errors}
        return cls({spec.id: spec for spec in specs}, kept, errors)

    def pick(self, ids: list[str] | tuple[str, ...]) -> dict[str, DataFrame]:
        """The available frames of the asked sources; an unknown id is an error."""
        if not ids:
            raise ValueError("Sélectionnez au moins une source.")
        unknown = [i for i in ids if i not in self.specs]
        if unknown:
            raise ValueError("Sources inconnues: " + ", ".join(unknown))
        return {i: self.frames[i] for i in ids if i in self.frames}

    def missing(self, ids: list[str] | tuple[str, ...]) -> list[str]:
        return [self.errors[i] for i in ids if i in self.errors]

    def kinds(self, kind: str) -> list[str]:
        return [i for i, spec in self.specs.items() if spec.kind == kind]

    def inventory(self, spark: SparkSession) -> DataFrame:
        """One row per declared source: availability, error, row and column counts."""
        types = {
            "id": "string", "position": "int", "label": "string", "kind": "string", "available": "boolean",
            "error": "string", "columns": "string", "n_columns": "int", "rows": "bigint",
        }
        lines = []
        for position, spec in enumerate(self.specs.values()):
            df = self.frames.get(spec.id)
            names = df.columns if df is not None else []
            known = (
                spec.id, position, spec.label, spec.kind, df is not None, self.errors.get(spec.id), ", ".join(names), len(names)
            )
            # Every source makes its own line: with one source, a join of counts to lines is a nested loop.
            one = spark.range(0, 1, 1, 1).select(F.lit(0).alias("rows"))
            counted = one if df is None else df.agg(F.count(F.lit(1)).alias("rows"))
            values = [F.lit(v) for v in known] + [F.col("rows")]
            lines.append(counted.select(*[v.cast(t).alias(n) for v, (n, t) in zip(values, types.items())]))
        if not lines:
            return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in types.items()))
        return reduce(DataFrame.unionAll, lines)

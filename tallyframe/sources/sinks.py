"""Writers: standardized tables, normalized tables, exports and JSON records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tallyframe import presets
from tallyframe.functions.cast import ref, without_nan
from tallyframe.operators.schema import align_union

ISO_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS", "dateFormat": "yyyy-MM-dd"}


def to_records(df: DataFrame, limit: int | None = None, order_key: str | None = None) -> DataFrame:
    """Each row as one JSON text: missing is null, dates are ISO. A head needs an order."""
    work = without_nan(df)
    if limit is not None:
        if order_key is None:
            raise ValueError("a head of the records needs an order_key")
        work = work.orderBy(ref(order_key)).limit(limit)
    return work.select(F.to_json(F.struct(*[ref(c) for c in work.columns]), ISO_JSON).alias("record"))


def null_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``rows``, ``columns`` and the list of columns without any value, in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(ref(name)).alias(f"n{i}") for i, name in enumerate(names)],
    )
    empty = [F.when(F.col(f"n{i}") == 0, F.lit(name)) for i, name in enumerate(names)]
    return counted.select(
        "rows", F.lit(len(names)).alias("columns"), F.concat_ws(", ", *empty).alias("missing_columns")
    )


def write_standardized(frames: Mapping[str, DataFrame], out: str) -> DataFrame:
    """Write every standardized source as Parquet and JSON records; return one audit row each.

    The audit reads the written Parquet, so the source plan runs once per written form.
    """
    audit = None
    for source, df in frames.items():
        spark = df.sparkSession
        table, records = f"{out}/table/source={source}", f"{out}/json/source={source}"
        df.write.parquet(table)
        written = spark.read.schema(df.schema).parquet(table)
        to_records(written).withColumnRenamed("record", "value").write.text(records)
        row = null_columns(written, written.columns).select(
            F.lit(source).alias("country"),
            "rows",
            "columns",
            "missing_columns",
            F.lit(table).alias("table_path"),
            F.lit(records).alias("json_path"),
            F.lit("success").alias("status"),
        )
        audit = row if audit is None else audit.unionByName(row)
    return audit


def checked_scores(
    df: DataFrame,
    column: str = presets.SCORE_COLUMN,
    score_range: tuple[float, float] = presets.SCORE_RANGE,
) -> DataFrame:
    """The same rows; a score outside the range fails the job that reads them."""
    score = F.col(column)
    fine = score.isNull() | score.between(*score_range)
    wrong = F.raise_error(F.concat(F.lit("Scores hors intervalle: "), score.cast("string"))).cast("double")
    return df.withColumn(column, F.when(fine, score).otherwise(wrong))


def write_normalized(
    consolidated: DataFrame,
    reference: DataFrame,
    out: str,
    source_column: str = "source",
    score_range: tuple[float, float] = presets.SCORE_RANGE,
) -> dict[str, str]:
    """Write the normalized rows once, partitioned by source, plus the code reference.

    One partitioned table serves as both the per-source and the consolidated output: a
    filter on the source column prunes to its folder. The range check rides along in the
    writing job: a score out of range fails it, and nothing is committed.
    """
    paths = {
        "table": f"{out}/normalized",
        "reference": f"{out}/product_reference",
    }
    checked_scores(consolidated, score_range=score_range).write.partitionBy(source_column).parquet(paths["table"])
    reference.write.json(paths["reference"], ignoreNullFields=False)
    return paths


def write_export(frames: Mapping[str, DataFrame], out: str, fmt: str = "csv") -> str:
    """All rows of the combined display table, whatever the sort and page of the view."""
    combined = align_union(frames)
    writer = combined.write
    if fmt == "csv":
        writer.csv(out, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSS")
    elif fmt == "parquet":
        writer.parquet(out)
    else:
        raise ValueError(f"Format non supporte: {fmt}")
    return out

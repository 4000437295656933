"""What a user can filter by: distinct values, date extent, column names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyframe import presets
from tallyframe.functions.cast import present, ts_of
from tallyframe.functions.text import strip, value_text
from tallyframe.operators.schema import visible_columns


def filter_values(frames: Mapping[str, DataFrame], fields: Sequence[str] = presets.FILTER_FIELDS) -> DataFrame:
    """The distinct printed values of each field over all sources, blanks left out.

    One job for all fields. Cells are unpivoted and made distinct before they are trimmed,
    so the text work is done once per value and not once per row.
    """
    parts = []
    for df in frames.values():
        cells = [
            F.struct(
                F.lit(name).alias("field"),
                value_text(present(name, df.schema[name].dataType), df.schema[name].dataType).alias("value"),
            )
            for name in fields
            if name in df.columns
        ]
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))))
    if not parts:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], "field string, value string")
    seen = reduce(DataFrame.unionByName, parts).distinct()
    values = seen.withColumn("value", strip("value"))
    named = values.filter((F.col("value") != "") & ~F.lower("value").isin("nan", "none"))
    return named.distinct().orderBy("field", "value")


def date_extent(frames: Mapping[str, DataFrame], columns: Sequence[str] = presets.DATE_COLUMNS) -> DataFrame:
    """First and last day over every date column of every source."""
    parts = []
    for df in frames.values():
        dates = [ts_of(df, name) for name in columns if name in df.columns]
        if dates:
            lows, highs = [F.min(d) for d in dates], [F.max(d) for d in dates]
            low = F.least(*lows) if len(lows) > 1 else lows[0]
            high = F.greatest(*highs) if len(highs) > 1 else highs[0]
            parts.append(df.agg(low.alias("low"), high.alias("high")))
    if not parts:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([(None, None)], "date_min string, date_max string")
    return reduce(DataFrame.unionByName, parts).agg(
        F.date_format(F.min("low"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("high"), "yyyy-MM-dd").alias("date_max"),
    )


def column_names(frames: Mapping[str, DataFrame]) -> list[str]:
    return sorted({name for df in frames.values() for name in visible_columns(df)})

"""Number, timestamp and rounding expressions with "bad value becomes null" rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# What counts as a number in text. Narrower than Spark's own cast, which takes "1.0d".
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"^(?i)\s*[+-]?inf(inity)?\s*$"

_NUMERIC = (T.NumericType,)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def ref(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(name: str, dtype: T.DataType) -> Column:
    """The column with NaN read as missing."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(ref(name), F.lit(None))
    return ref(name)


def without_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every float column (once, at ingest)."""
    floats = {
        f.name: present(f.name, f.dataType)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def num(column: Column | str, dtype: T.DataType | None = None) -> Column:
    """To double, or null. Text is checked against a number pattern before the cast.

    Passing the known ``dtype`` of a numeric column skips the text check and keeps the
    comparison in a form the Parquet reader can use.
    """
    c = F.col(column) if isinstance(column, str) else column
    if dtype is not None and is_numeric(dtype):
        return F.nanvl(c.cast("double"), F.lit(None))
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    text = c.cast("string")
    looks_numeric = text.rlike(_NUMBER) | text.rlike(_INFINITY)
    return F.when(looks_numeric, F.trim(text).try_cast("double"))


def num_of(df: DataFrame, name: str) -> Column:
    return num(ref(name), df.schema[name].dataType)


def ts_of(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; one that is already passes bare, so scans can filter on it."""
    return ref(name) if isinstance(df.schema[name].dataType, T.TimestampType) else ts(ref(name))


def ts(column: Column | str, formats: tuple[str, ...] = ()) -> Column:
    """To timestamp, or null; extra formats are tried in order after the ISO forms."""
    c = F.col(column) if isinstance(column, str) else column
    tried = [c.try_cast("timestamp")]
    tried += [F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in formats]
    return F.coalesce(*tried) if formats else tried[0]


def month_key(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM")


def round3(column: Column) -> Column:
    return F.round(column, 3)


def clip(column: Column, low: Column, high: Column) -> Column:
    """Keep the value inside the bounds; null stays null and null bounds do nothing.

    ``least``/``greatest`` skip nulls, so a missing value must be guarded or it would
    become a bound.
    """
    return F.when(column.isNotNull(), F.least(F.greatest(column, low), high))


def unpivoted(lines: list[Column], fields: str) -> Column:
    """One output row per struct; ``fields`` names the columns when there is no struct at all."""
    if lines:
        return F.inline(F.array(*lines))
    return F.inline(F.from_json(F.lit("[]"), f"array<struct<{fields}>>"))

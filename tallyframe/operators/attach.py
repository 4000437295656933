"""Joining a small keyed table to a large one, with its size checked first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.cast import ref
from tallyframe.session import materialize

# A lookup is sent to every executor only if it is no larger than this, as printed text.
BROADCAST_BYTES = 20_000_000
# No single row of such a lookup is longer than this.
ROW_BYTES = 1_000


@dataclass(frozen=True)
class Lookup:
    """A keyed table that was measured: ``small`` ones are local and may be broadcast."""

    table: DataFrame
    keys: tuple[str, ...]
    small: bool


def measure(
    df: DataFrame,
    keys: Sequence[str],
    max_bytes: int = BROADCAST_BYTES,
    row_bytes: int = ROW_BYTES,
) -> Lookup:
    """Compute a lookup once and decide how it may be joined.

    Rows longer than ``row_bytes`` stay where they are, so what reaches the driver is never
    larger than ``max_bytes``. A table with a longer row, or with more rows than that allows,
    is written out, so that the join reads it instead of computing it again.
    """
    max_rows = max_bytes // row_bytes
    whole = F.struct(*[ref(c) for c in df.columns])
    short = F.octet_length(whole.cast("string")) <= row_bytes
    head = [row[0] for row in df.limit(max_rows + 1).select(F.when(short, whole)).collect()]
    if len(head) <= max_rows and None not in head:
        spark = df.sparkSession
        return Lookup(spark.createDataFrame(head, df.schema), tuple(keys), True)
    return Lookup(materialize(df, "lookup"), tuple(keys), False)


def attach(df: DataFrame, lookup: Lookup, how: str = "left") -> DataFrame:
    """Join the lookup's columns to ``df`` by its keys, one match per row at most.

    Small lookups are broadcast, so the large side is not moved. Beyond that both sides are
    joined by Spark's own choice; adaptive execution splits the rows of a hot key over
    several tasks. A lookup without keys has one row at most; its values enter as constants.
    """
    keys = list(lookup.keys)
    if not keys:
        row = lookup.table.first()
        made = {f.name: F.lit(row and row[f.name]).cast(f.dataType) for f in lookup.table.schema}
        joined = df.withColumns(made)
        return joined if row is not None or how == "left" else joined.limit(0)
    if lookup.small:
        return df.join(F.broadcast(lookup.table), keys, how)
    return df.join(lookup.table, keys, how)


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """A lookup with a repeated key would multiply rows; say so before it does."""
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"repeated lookup keys: {[tuple(r)[:-1] for r in repeated]}")

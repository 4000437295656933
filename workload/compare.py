"""Comparing a Spark result with DuckDB's answer to the same SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Sequence

import duckdb

from workload.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def normal_rows(columns: Sequence[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in a fixed order, as the comparison needs them."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(made, key=repr)


def spark_rows(df):
    return normal_rows(df.columns, df.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, text: str):
    result = con.execute(text)
    return normal_rows([d[0] for d in result.description], result.fetchall())

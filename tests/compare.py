"""Side-by-side runs of a query in Spark and of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    return names, sorted(rows, key=_sort_key)


def duck_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=_sort_key)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, exactly, types and floats included; empty if nothing does."""
    names, rows = spark_rows(df)
    want_names, want = duck_rows(connection, sql)
    if names != want_names:
        return [f"columns {names} != {want_names}"]
    if len(rows) != len(want):
        return [f"{len(rows)} rows != {len(want)} rows"]
    return [
        f"{a} != {b}"
        for a, b in zip(rows, want, strict=True)
        if not all(same(x, y) for x, y in zip(a, b, strict=True))
    ]

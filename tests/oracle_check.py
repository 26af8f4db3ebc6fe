"""Compare registered queries with their DuckDB SQL, cell by cell."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

# Spark type name -> the DuckDB type a matching column has.
_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sortable(value: object) -> tuple:
    if value is None:
        return (0, "")
    if isinstance(value, (date, datetime)):
        return (1, value.isoformat())
    if isinstance(value, (bool, int, float, Decimal)):
        return (2, float(value))
    return (3, str(value))


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple(_sortable(value) for value in row))


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if columns, types and all values agree; else what does not."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    kinds = {column[0]: str(column[1]) for column in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected_kinds = {name: _TYPES.get(kind, kind) for name, kind in df.dtypes}
    if expected_kinds != kinds:
        wrong = {n: (expected_kinds[n], kinds[n]) for n in kinds if expected_kinds[n] != kinds[n]}
        return f"types {wrong}"
    theirs = _rows(names, result.fetchall())
    ours = _rows(df.columns, [tuple(row) for row in df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for mine, other in zip(ours, theirs, strict=True):
        if mine != other:
            return f"{mine} != {other}"
    return None

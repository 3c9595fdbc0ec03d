"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return str(value)
        return round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda row: tuple(map(repr, row))
    )


def difference(spark, connection, query, sql, sf_dir) -> str | None:
    """None if equal, else a short description."""
    frame = query(spark, sf_dir)
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    expected = rows_of(names, result.fetchall())
    if got == expected:
        return None
    only_got = [row for row in got if row not in set(expected)][:3]
    only_expected = [row for row in expected if row not in set(got)][:3]
    return f"{len(got)} rows, expected {len(expected)}; got only {only_got}; expected only {only_expected}"

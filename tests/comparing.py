"""Comparison of a Spark result with the result of a SQL text in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def duck(folder: Path):
    connection = duckdb.connect()
    for file in sorted(folder.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def normal(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else (int(value) if value == int(value) else value)
    if isinstance(value, decimal.Decimal):
        return normal(float(value))
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(found, key=lambda row: tuple((value is not None, str(type(value)), str(value)) for value in row))


def assert_same(df, connection, sql):
    result = connection.execute(sql)
    expected_names = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(expected_names)
    expected = rows_of(expected_names, result.fetchall())
    actual = rows_of(df.columns, [tuple(row) for row in df.collect()])
    assert len(actual) == len(expected)
    for a, b in zip(actual, expected):
        assert a == b

"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(root: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(root, f"{name}.parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def key(row):
    return [(v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", repr(v)) for v in row]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [[plain(r[i]) for i in order] for r in rows]
    return sorted(columns), sorted(out, key=key)


def compare(spark, connection, root, query, sql):
    """None when equal, else a short description of the first difference."""
    df = query(spark, root)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b or [type(x) is bool for x in a] != [type(x) is bool for x in b]:
            return f"{dict(zip(got_columns, a))} != {dict(zip(got_columns, b))}"
    if [f.dataType.simpleString() for f in df.schema.fields] and not got:
        return "no rows"
    return None

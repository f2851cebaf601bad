"""Compare a Spark result with the same query in DuckDB: names, row count, and every value."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> str:
    """Empty when both results agree, else a short report."""
    cursor = connection.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(df.columns) != sorted(sql_names):
        return f"columns {sorted(df.columns)} != {sorted(sql_names)}"
    found = df.collect()
    left, right = _rows(df.columns, found), _rows(sql_names, expected)
    if left == right:
        return ""
    return (
        f"rows {len(found)} vs {len(expected)}; only spark {list((left - right).items())[:3]}; "
        f"only sql {list((right - left).items())[:3]}"
    )

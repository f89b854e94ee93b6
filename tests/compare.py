"""Compare a Spark result with the same query run by DuckDB on the same tables."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql) -> str | None:
    """None when both agree, else a short account of how they differ."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    ours = rows_of(df.columns, df.collect())
    if sorted(c.lower() for c in names) != sorted(c.lower() for c in df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        only = set(map(repr, ours)) ^ set(map(repr, theirs))
        return f"{len(ours)} rows against {len(theirs)}; e.g. {sorted(only)[:4]}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ; first {wrong[0]}"
    kinds = {type(v) for r in ours for v in r} ^ {type(v) for r in theirs for v in r}
    return f"value types differ: {kinds}" if kinds - {type(None)} else None

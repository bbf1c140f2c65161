"""Comparing a Spark result with the rows of its SQL, whatever the order."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime):
        return value.isoformat(sep=" ", timespec="microseconds")
    if isinstance(value, date):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    """An in-process database with the Parquet tables of ``folder`` as views."""
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def differences(df, got, cursor) -> str | None:
    """None when names and rows agree, else what does not."""
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return None
    in_a, in_b = set(a), set(b)
    return (
        f"{len(a)} rows against {len(b)}\n   spark {[x for x in a if x not in in_b][:3]}"
        f"\n   sql   {[x for x in b if x not in in_a][:3]}"
    )

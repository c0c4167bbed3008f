"""Rows of a query and of its SQL in DuckDB, brought to one form and compared as bags."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x: object) -> object:
    """One form for a value of either engine; floats to nine digits."""
    if isinstance(x, bool) or x is None or isinstance(x, str | bytes):
        return x
    if isinstance(x, int):
        return float(x) if abs(x) < 2**53 else x
    if isinstance(x, float | decimal.Decimal):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x if isinstance(x, datetime.date) else str(x)


def bag(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    found = [tuple(r.asDict(recursive=True)[c] for c in df.columns) for r in df.collect()]
    con.execute(sql)
    names = [c[0] for c in con.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = bag(df.columns, found), bag(names, con.fetchall())
    if a == b:
        return ""
    return f"{a.total()} against {b.total()} rows; only here {list((a - b).items())[:2]}, only there {list((b - a).items())[:2]}"

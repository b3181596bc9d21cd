"""Compare a query with its SQL twin: same columns, same rows, any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(folder, t)}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else number + 0.0
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(df, con, sql) -> str:
    """Empty when the two agree, otherwise what differs."""
    cursor = con.execute(sql)
    want_columns, want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if want_columns != got_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(want) != len(got):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(want)} rows differ: {bad[:2]}" if bad else ""

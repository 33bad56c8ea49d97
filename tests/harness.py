"""Runs a query and its SQL on the same tables and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    return x


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def compare(df, sql: str, con) -> str:
    """An empty string, or what differs."""
    relation = con.sql(sql)
    want_columns, got_columns = list(relation.columns), list(df.columns)
    if sorted(want_columns) != sorted(got_columns):
        return f"columns {sorted(got_columns)} and {sorted(want_columns)}"
    want, got = rows_of(want_columns, relation.fetchall()), rows_of(got_columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""

"""Runs a query and its SQL twin and compares their rows, columns sorted by name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, folder: str, query, sql: str) -> list:
    df = query(spark, folder)
    own = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = connect(folder)
    found = con.execute(sql)
    theirs = rows_of([c[0] for c in found.description], found.fetchall())
    if own[0] != theirs[0]:
        return [("columns", own[0], theirs[0])]
    if len(own[1]) != len(theirs[1]):
        return [("rows", len(own[1]), len(theirs[1]))]
    return [(a, b) for a, b in zip(own[1], theirs[1], strict=True) if a != b and [_plain(x) for x in a] != [_plain(x) for x in b]]

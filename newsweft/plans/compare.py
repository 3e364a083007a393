"""Holding a query's rows against its DuckDB counterpart, whatever the order of rows and columns."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, Decimal):
        return f"{float(value):.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_plain, value)) + "]"
    return repr(value)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both give the same rows, else what differs first."""
    ours = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    got = con.execute(sql)
    theirs = canonical([c[0] for c in got.description], got.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] == theirs[1]:
        return ""
    a, b = set(ours[1]), set(theirs[1])
    return f"{len(ours[1])} and {len(theirs[1])} rows; only here {sorted(a - b)[:1]}, only there {sorted(b - a)[:1]}"

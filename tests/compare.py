"""A query's rows against those of its SQL twin."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(x: object) -> str:
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "-"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if hasattr(x, "item"):
        return _cell(x.item())
    return str(x)


def rows(columns: list[str], data: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in data)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    con = connect(sf_dir)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs, ours = rows(names, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        a, b = set(ours), set(theirs)
        return f"{len(ours)} and {len(theirs)} rows; only ours {sorted(a - b)[:3]}, only theirs {sorted(b - a)[:3]}"
    return ""

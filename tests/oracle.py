"""Run queries and their oracles side by side: row count, column names and values."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int | str | bool | bytes | type(None) | datetime.datetime):
        return x
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return str(x)


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if they agree, else what differs."""
    df = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    ours = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if a == b:
        return ""
    only = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} and {len(b)} rows; only here {str(only[0])[:600]}; only there {str(only[1])[:600]}"


__all__ = ["compare", "connect", "glob"]

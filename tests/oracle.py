"""Runs a query and its SQL on the same tables and compares the rows as bags."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, sql: str, sf_dir: str) -> tuple[int, Counter, Counter]:
    """Row count, rows only Spark has, rows only SQL has. Column names must agree."""
    con = tables(sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(spark_df.columns), (sorted(names), sorted(spark_df.columns))
    b = bag(names, want.fetchall())
    a = bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    return sum(a.values()), a - b, b - a

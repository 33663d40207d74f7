"""Rows of a query against DuckDB's for the same tables."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    c = sorted(df.columns)
    return c, sorted(tuple(plain(v) for v in r) for r in df[c].itertuples(index=False))


def assert_same(spark, con, sf, query, sql):
    ours, theirs = rows(query(spark, sf).toPandas()), rows(con.execute(sql).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]

"""Compares a query with its DuckDB oracle, rows in any order, numbers to six places."""

from __future__ import annotations

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if v != v else round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle_rows(sf_dir: str, sql: str, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)

"""Compares a query with its SQL on the same files."""

import glob
import math
import os

import duckdb


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    mine = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    theirs = sorted(tuple(_cell(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs
    return len(mine)

"""Comparing a Spark result with DuckDB's on the same tables."""

import glob
import math
import os

import duckdb


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def connect(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(r[k]) for k in cols) for r in df.collect())


def duck_rows(c, sql):
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(k) for k in cols]
    return cols, sorted(tuple(cell(x[i]) for i in at) for x in r.fetchall())

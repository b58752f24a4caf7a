"""Compares a query's rows with DuckDB's, whatever their order."""

import glob
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool):
        return str(v)
    return "null" if v is None else f"{v:.6g}" if isinstance(v, int) and abs(v) > 1e15 else str(float(f"{v:.6g}")) if isinstance(v, int) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(float(x)) if (x := plain(r[i])).replace(".", "", 1).replace("-", "", 1).isdigit() else x for i in order) for r in rows)


def same(df, sql, folder):
    rel = connect(folder).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want

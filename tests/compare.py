"""A query's rows against its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def views(path):
    con = duckdb.connect()
    for p in glob.glob(f"{path}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


def same(df, con, sql):
    names = sorted(df.columns)
    a = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    got = con.execute(sql)
    there = [x[0] for x in got.description]
    b = sorted(repr([plain(r[there.index(c)]) for c in sorted(there)]) for r in got.fetchall())
    assert names == sorted(there)
    assert a == b

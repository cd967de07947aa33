"""Runs a registered query and its SQL twin over one data set and compares all rows."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, f, sql, sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if glob.glob(p + '/*') else ''}'")
    df, rel = f(spark, sf), con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    key = lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, tuple) else (True, "t", str(x)) for x in r)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    want = sorted((tuple(plain(x) for x in r) for r in rel.select(*[f'"{n}"' for n in names]).fetchall()), key=key)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9), (a, b)
    return got

"""Rows of a query against rows of SQL, whatever their order."""

import math
from decimal import Decimal

import duckdb


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def tables(sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def both(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    res = con.execute(sql)
    there = [d[0] for d in res.description]
    assert sorted(there) == names
    want = sorted((tuple(plain(r[there.index(n)]) for n in names) for r in res.fetchall()), key=repr)
    return got, want

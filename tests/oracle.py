"""Runs a query and its SQL on the same files and compares all rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def rows_of_df(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def same(df, sql, folder):
    a, b = rows_of_df(df), rows_of_sql(sql, folder)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert [(x, y) for x, y in zip(a[1], b[1]) if x != y][:5] == []

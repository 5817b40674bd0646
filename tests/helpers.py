"""Comparison of a query with its SQL, as sets of rows with rounded numbers."""

import datetime
import decimal
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connect(folder=DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def same(spark, con, query, sql, folder=DATA):
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs

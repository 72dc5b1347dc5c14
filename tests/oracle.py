"""Runs a query and its SQL over the same tables and compares the rows."""

import decimal
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "NaN" if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def assert_same(df, sql, folder=DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    columns = sorted(df.columns)
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
    assert ours

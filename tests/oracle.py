"""Runs a query in Spark and its SQL in DuckDB, and compares the rows."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float) and v != v:
        return None
    return v


def check(spark, name, queries, sql, sf=SF):
    df = queries[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    rel = con.sql(sql[name])
    assert sorted(rel.columns) == cols
    want = sorted(repr(tuple(plain(r[rel.columns.index(c)]) for c in cols)) for r in rel.fetchall())
    assert got == want

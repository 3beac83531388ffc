"""Rows of a query and of its DuckDB statement over the same files."""

import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return bytes(value) if isinstance(value, (bytearray, memoryview)) else value


def both(spark, query, sql):
    """(columns, rows) of either engine, columns and rows sorted."""
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}'")
    df, relation = query(spark, DATA), con.sql(sql)
    ours, theirs = sorted(df.columns), sorted(relation.columns)
    index = [relation.columns.index(c) for c in theirs]
    a = sorted((tuple(_plain(r[c]) for c in ours) for r in df.collect()), key=repr)
    b = sorted((tuple(_plain(r[i]) for i in index) for r in relation.fetchall()), key=repr)
    return (ours, a), (theirs, b)

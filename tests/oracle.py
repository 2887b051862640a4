"""Holds a query's rows against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(con, spark, query, sql, sf):
    df = query(spark, sf)
    cols = sorted(df.columns)
    assert cols == sorted(con.sql(sql).columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall()), key=repr)
    assert got == want
    return len(got)

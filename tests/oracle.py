"""Queries against their SQL in DuckDB, value by value."""

import decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (float, decimal.Decimal)) or "float" in type(v).__name__:
        v = round(float(v), 5)
        return int(v) if v.is_integer() else v  # a nullable integer comes as a float from one side
    if "int" in type(v).__name__:
        return int(v)
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


def compare(spark, sf, run, sql):
    got, want = run(spark, sf).toPandas(), connect(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

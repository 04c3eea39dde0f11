"""Compare a query with its SQL twin in DuckDB, whatever the order of rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = plain(a), plain(b)
    assert len(x) == len(y)
    assert x == y

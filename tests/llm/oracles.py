"""Spark rows against DuckDB rows of the same tables."""

import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same_rows(df, con, sql):
    found = df.toPandas()
    expected = con.execute(sql).df()
    assert sorted(found.columns) == sorted(expected.columns)
    names = sorted(found.columns)
    rows = lambda t: sorted(map(repr, t[names].astype(object).itertuples(index=False, name=None)))
    assert len(found) == len(expected) > 0
    assert rows(found) == rows(expected)

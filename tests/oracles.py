"""Spark rows against DuckDB rows of the same tables."""

import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return repr(value.item() if hasattr(value, "item") else value)


def same_rows(df, con, sql):
    found = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(df.columns) == [names[i] for i in order]
    expected = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    assert len(found) == len(expected) > 0, (len(found), len(expected))
    rows = lambda t: sorted(tuple(map(plain, r)) for r in t)
    a, b = rows(found), rows(expected)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    assert len(set(a)) > 1

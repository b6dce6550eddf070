"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def canonical(v) -> str:
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float) or v.__class__.__name__ == "Decimal":
        return f"{float(v):.9g}" if float(v) != int(v) else str(int(v))
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(canonical(r[k]) for k in order) for r in rows)


def assert_equal(df, con, sql: str) -> int:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, found.fetchall())
    assert got == want
    return len(got)

"""Comparing a query with its DuckDB oracle, as unordered rows."""

import math
import os

import duckdb


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False))


def same(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    got, want = rows(df.toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]

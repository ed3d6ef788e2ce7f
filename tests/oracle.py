"""Runs a query's SQL in DuckDB over a folder of tables, and compares rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return c


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return ("nan" if math.isnan(v) else str(v)) if not math.isfinite(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(df, sql: str, folder: str) -> None:
    r = connect(folder).sql(sql)
    names = sorted(df.columns)
    assert names == sorted(r.columns)
    kinds = dict(zip(r.columns, map(str, r.types)))
    assert {k: TYPES[v] for k, v in df.dtypes} == kinds
    want = canon(r.select(*[f'"{n}"' for n in names]).fetchall())
    got = canon(tuple(x[n] for n in names) for x in df.collect())
    assert len(got) == len(want)
    assert got == want

"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        name = os.path.basename(f)[:-8]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def cell(v) -> str:
    if v is None or v != v:
        return "<null>"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    return str(v)


def same(df, c, sql: str) -> None:
    names = sorted(df.columns)
    ours = sorted(tuple(cell(r[k]) for k in names) for r in df.collect())
    cursor = c.execute(sql)
    theirs_names = [x[0] for x in cursor.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(k) for k in names]
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in cursor.fetchall())
    assert ours == theirs

"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}")
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10] if str(x).endswith("00:00:00") else str(x)
    return x if isinstance(x, (int, str, bool, type(None))) else float(x)


def compare(df, sql: str, sf_dir: str) -> str:
    """An empty string, or what differs."""
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    want = db.sql(sql)
    names = sorted(want.columns)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {names}"
    at = [want.columns.index(c) for c in names]
    theirs = sorted((repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall()))
    mine = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    if mine == theirs:
        return ""
    return f"{len(mine)} rows instead of {len(theirs)}; first only here {sorted(set(mine) - set(theirs))[:2]}, only there {sorted(set(theirs) - set(mine))[:2]}"

"""Runs a query and its SQL and compares their rows, in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def compare(spark, con, sf_dir: str, query, sql: str) -> None:
    got = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    cols = sorted(names)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    have = sorted(tuple(_plain(r[c]) for c in cols) for r in got.toArrow().to_pylist())
    assert have == want

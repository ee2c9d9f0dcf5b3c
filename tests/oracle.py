"""Runs queries in Spark and their SQL in DuckDB and compares rows without regard to order."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, query, sql, sf_dir) -> str:
    """Empty if both sides are equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    other = con.sql(sql)
    theirs = rows(other.columns, other.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1], strict=True):
        if a != b:
            return f"{a} against {b}"
    return ""

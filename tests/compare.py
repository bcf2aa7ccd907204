"""Runs a query and its DuckDB twin on the same tables and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_norm, v)) + "]"
    return str(v)


def oracle_rows(sql: str, sf: str = SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), sorted(tuple(_norm(r[names.index(n)]) for n in sorted(names)) for r in got.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_norm(r[n]) for n in names) for r in df.collect())


def assert_same(spark, query, sql: str, sf: str = SF) -> None:
    assert spark_rows(query(spark, sf)) == oracle_rows(sql, sf)

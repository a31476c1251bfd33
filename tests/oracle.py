"""Comparison of a named query with its SQL in DuckDB."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import numpy as np


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return Counter(tuple(norm(r[c]) for c in names) for r in df.collect())


def sql_rows(con, sql):
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(rel.columns), Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def assert_matches(spark, sf, con, query, sql):
    df = query(spark, sf)
    names, wanted = sql_rows(con, sql)
    assert sorted(df.columns) == names
    found = rows_of(df)
    assert found == wanted, (list((found - wanted))[:3], list((wanted - found))[:3])

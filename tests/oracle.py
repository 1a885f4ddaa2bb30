"""Compares a query with its SQL in DuckDB."""

import datetime
import decimal
import math

from pathlib import Path

import duckdb

DATA = Path("/root/testdata")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def both(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = con.sql(sql)
    assert cols == sorted(found.columns)
    at = [found.columns.index(c) for c in cols]
    return ours, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())

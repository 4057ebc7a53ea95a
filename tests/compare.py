"""Run registered queries next to their SQL in DuckDB and compare names, counts and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (0.0 if x == 0 else x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(repr(plain(r[i])) for i in order) for r in data]
    return [names[i] for i in order], sorted(out)


def difference(df, con, sql: str) -> str | None:
    """None if both results agree, else what differs."""
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_names, want = rows(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{len(got)} rows != {len(want)}; {extra}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}"
    return None

"""Compares a query's rows with what DuckDB makes of its oracle SQL."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return [found.columns[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in found.fetchall()), key=repr)

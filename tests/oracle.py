"""Compares a query's rows with those of its SQL."""

import math
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((repr([plain(v) for v in row]) for row in df.select(*columns).collect()))


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    place = [found.columns.index(c) for c in columns]
    return columns, sorted(repr([plain(row[i]) for i in place]) for row in found.fetchall())


def agree(spark, query, sql, sf_dir):
    got, wanted = rows_of(query(spark, sf_dir)), sql_rows(sql, sf_dir)
    assert got[0] == wanted[0]
    assert len(got[1]) == len(wanted[1])
    assert got[1] == wanted[1]

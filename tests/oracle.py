"""Rows of a query and of its SQL, made comparable."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def order(row):
    return tuple((x is None, str(type(x)), x) for x in row)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.select(*names).collect()), key=order)


def of_sql(con, sql):
    rel = con.sql(sql)
    at = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    return sorted(rel.columns), sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=order)

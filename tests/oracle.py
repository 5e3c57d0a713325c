"""Runs a query and its SQL on the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(dicts, columns):
    return sorted("|".join(plain(r[c]) for c in columns) for r in dicts)


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    found = connect(sf_dir).sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(df.columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows([dict(zip(found.columns, x)) for x in found.fetchall()], columns)

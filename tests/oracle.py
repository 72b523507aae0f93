"""Comparison of a query with its SQL in DuckDB."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio"):
        return None if math.isnan(x) else round(float(x), 5) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: [(v is None, str(v)) for v in r]
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=key)


def same(spark_rows, sql_rows):
    if len(spark_rows) != len(sql_rows):
        return False
    for a, b in zip(spark_rows, sql_rows, strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))):
                return False
    return True

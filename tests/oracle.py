"""Compares queries with their SQL in DuckDB, row by row."""

import datetime
import math
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True)), key=repr)


def connection():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con

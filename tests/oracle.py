"""Comparing a query with DuckDB SQL on the same tables, row for row whatever the order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return "NULL"
    if isinstance(v, float):
        return str(round(v, 6))
    return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    return sorted(found.columns), rows_of(found.columns, found.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def assert_same(df, sql, sf_dir):
    assert spark_rows(df) == duck_rows(sql, sf_dir)

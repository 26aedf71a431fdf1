"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def text(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[n]) for n in names) for r in df.collect())


def sql_rows(sql, sf=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in result.fetchall())

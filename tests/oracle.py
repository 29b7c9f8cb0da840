"""Run a query and its SQL and compare the rows."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else glob.escape(path)}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(map(repr, (r[i] for i in order))) for r in rows)


def agrees(spark, con, sf_dir, query, sql):
    df, answer = query(spark, sf_dir), con.sql(sql)
    assert sorted(df.columns) == sorted(answer.columns)
    got, expected = rows_of(df.columns, df.collect()), rows_of(answer.columns, answer.fetchall())
    assert got == expected
    return len(got)

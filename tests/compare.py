"""Rows of a Spark query and of its SQL in DuckDB, in one order and spelling."""

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spell(v):
    return repr(v) if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(spell(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    columns = sorted(names)
    return columns, sorted(tuple(spell(r[names.index(c)]) for c in columns) for r in cur.fetchall())

"""Compare a registered query with its SQL on DuckDB."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([_plain(r[c]) for c in columns]) for r in df.select(*columns).collect())


def rows_from(con, text):
    result = con.execute(text)
    names = [x[0] for x in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(repr([_plain(r[i]) for i in at]) for r in result.fetchall())


def _plain(value):
    return repr(value) if isinstance(value, float) else str(value)

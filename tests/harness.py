"""Compares a Spark result with DuckDB's, as sets of rows with rounded numbers."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir, **views):
    con = duckdb.connect()
    for t in TABLES:
        if t not in views and os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, frame in views.items():
        con.register(name, frame)
    return con


def _cell(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return repr([_cell(x) for x in v])
    if pd.isna(v):
        return "-"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.7g}"
    return str(v)


def rows(frame, columns=None):
    frame = frame[sorted(columns or frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.astype(object).itertuples(index=False))


def assert_same(spark_df, sql, con):
    own, other = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert rows(own) == rows(other)

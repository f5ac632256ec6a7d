"""Run a DuckDB oracle on the given tables and compare it with a DataFrame, row by row, whatever the order."""

import os
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/**/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return connection.execute(sql).df()


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "__index__"):
        return int(v)
    return round(float(v), 4) if isinstance(v, float) or type(v).__name__.startswith("float") else v


def counted(frame):
    columns = sorted(frame.columns)
    return Counter(tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def assert_same(df, sql, sf_dir):
    got, want = df.toPandas(), oracle(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert counted(got) == counted(want)

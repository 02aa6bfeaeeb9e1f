"""Compare a query's rows with DuckDB SQL over the same tables."""

import glob
import os

import duckdb
import pandas as pd


def _cell(x):
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return "None"
    if isinstance(x, float) and x == int(x):
        return str(int(x))
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False))


def sql_rows(sql, folder):
    base = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return rows(base.sql(sql).df())

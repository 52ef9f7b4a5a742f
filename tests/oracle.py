"""Compare a Spark result with DuckDB's, whatever the order of rows."""

import duckdb
import numpy as np
import pandas as pd


def connection(sf, tables):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def rows(df):
    df, out = df[sorted(df.columns)], []
    for r in df.itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else f"{float(v):.6g}" if hasattr(v, "__float__") and not isinstance(v, (str, bool, np.bool_)) else str(v) for v in r))
    return sorted(out)

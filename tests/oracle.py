"""Comparison of a registered query with its SQL on DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(cell, x)) if hasattr(x, "__len__") and not isinstance(x, str | bytes) else x


def rows(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr(tuple(map(cell, r))) for r in df[columns].itertuples(index=False, name=None))


def expected(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchdf()

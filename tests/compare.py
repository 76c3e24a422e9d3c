"""Run a query in Spark and its SQL in DuckDB and compare rows as multisets."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False, name=None):
        out.append(tuple(None if x is None or x is pd.NA or x is pd.NaT or x != x else str(x)[:10] if hasattr(x, "year") else round(float(x), 9) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x for x in r))
    return sorted(out, key=repr)

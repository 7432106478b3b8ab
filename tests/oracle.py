"""Compare a query with its SQL in DuckDB, whatever the order of rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None))


def assert_same(spark_frame, sql: str, sf_dir: str) -> int:
    mine, theirs = spark_frame.toPandas(), connect(sf_dir).execute(sql).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = plain(mine), plain(theirs)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, different[:3]
    return len(a)

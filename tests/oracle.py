"""Compare a query with its SQL, as the driver does."""

from __future__ import annotations

import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def rows(frame) -> list[str]:
    def plain(v):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return v
        return None if math.isnan(v) else round(float(v), 6) + 0.0

    cols = sorted(frame.columns)
    f = frame[cols].astype(object)
    return sorted(repr(tuple(plain(v) for v in r)) for r in f.where(f.notna(), None).values.tolist())


def same(spark, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

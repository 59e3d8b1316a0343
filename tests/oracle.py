"""Compare a query with its SQL on DuckDB: names, row counts and sorted values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def _key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    return str(v)


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in values)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want, got = rows(names, rel.fetchall()), rows(df.columns, df.collect())
    assert len(want) == len(got), (len(want), len(got))
    bad = [(w, g) for w, g in zip(want, got, strict=True) if w != g]
    assert not bad, (len(bad), bad[:3])

"""Side by side: a query in Spark and its SQL twin in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(d: str = DATA):
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{d}/{t}')")
    return con


def level(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [level(x) for x in v]
    return v


def rows_of(table) -> list[str]:
    cols = sorted(table.column_names)
    return sorted(str([level(r[c]) for c in cols]) for r in table.to_pylist())


def compare(spark, query, sql: str, con, d: str = DATA) -> None:
    ours = query(spark, d).toArrow()
    theirs = con.sql(sql).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows_of(ours) == rows_of(theirs)

"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if abs(value) >= 1e15 else repr(round(value, 6) + 0.0)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> list[str]:
    """What differs; empty when nothing does."""
    con.execute(sql)
    duck_columns = [d[0] for d in con.description]
    duck = rows_of(duck_columns, con.fetchall())
    spark = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(df.columns) != sorted(duck_columns):
        problems.append(f"columns {sorted(df.columns)} / {sorted(duck_columns)}")
    if spark != duck:
        only_spark, only_duck = spark - duck, duck - spark
        problems.append(
            f"rows {sum(spark.values())} / {sum(duck.values())}; only Spark {sum(only_spark.values())} "
            f"{[str(r)[:200] for r in list(only_spark)[:3]]}; "
            f"only DuckDB {sum(only_duck.values())} {[str(r)[:200] for r in list(only_duck)[:3]]}"
        )
    return problems

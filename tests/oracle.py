"""Compare a query with its oracle: rows as sorted tuples, columns by name, doubles to six places."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x: object) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6f}".replace("-0.000000", "0.000000")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows_of(names: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def expected(sf_dir: str, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows_of(names, got.fetchall())


def actual(df: DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())

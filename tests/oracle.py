"""Compares a query's rows with its SQL in DuckDB over the same parquet files."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{p}'")
    return c


def canonical(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(canonical, x))
    return x


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    rel = con.sql(sql)
    out = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} and {sorted(rel.columns)}"]
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(rel.columns, rel.fetchall())
    if a != b:
        out.append(f"rows {sum(a.values())} and {sum(b.values())}; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}")
    return out

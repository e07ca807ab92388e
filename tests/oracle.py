"""Runs a query and its SQL on the same tables and compares the rows as multisets."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    cols = list(rel.columns)
    order = sorted(range(len(cols)), key=cols.__getitem__)
    return sorted(cols), Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def differences(df, sql: str, sf_dir: str) -> str:
    (c1, a), (c2, b) = spark_rows(df), sql_rows(sql, sf_dir)
    if c1 != c2:
        return f"columns {c1} against {c2}"
    if a != b:
        return f"{sum(a.values())} against {sum(b.values())} rows; only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
    return ""

"""Queries against their SQL: rows, column names and values, order aside."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def differences(df, con, sql: str) -> str:
    rel = con.sql(sql)
    names, cols = list(rel.columns), list(df.columns)
    if sorted(names) != sorted(cols):
        return f"columns {sorted(set(names) ^ set(cols))}"
    order = sorted(cols)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = Counter(tuple(plain(v) for v in (r[names.index(c)] for c in order)) for r in rel.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows, SQL {sum(want.values())}; only ours {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"

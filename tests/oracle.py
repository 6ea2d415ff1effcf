"""Compare registered queries with their SQL: same columns, same rows, any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"f:{v!r}"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    return f"s:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    got_names = spark_df.columns
    got = rows_of(got_names, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    want = rows_of(want_names, cur.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}"
    return None if got else "no rows"

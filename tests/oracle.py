"""Run a query and its SQL check on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_key(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str):
    """None if both agree, else a short account of the difference."""
    frame = fn(spark, sf_dir)
    mine = [tuple(r) for r in frame.collect()]
    rel = con.execute(sql)
    names, kinds = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    theirs = rel.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    spark_kinds = dict(frame.dtypes)
    odd = []
    for n, k in zip(names, kinds):
        want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "date": "DATE"}.get(spark_kinds[n])
        if want and want != k:
            odd.append(f"{n}: {spark_kinds[n]} vs {k}")
    a, b = rows_of(frame.columns, mine), rows_of(names, theirs)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}; only spark {only_a}; only sql {only_b}"
    return ("types " + ", ".join(odd)) if odd else None

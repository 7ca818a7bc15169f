"""Run a registered query on Spark and its statement on DuckDB and compare schema, count and values."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

from pricelens.registry import base

_CON: dict[str, duckdb.DuckDBPyConnection] = {}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    if sf_dir not in _CON:
        con = duckdb.connect()
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        _CON[sf_dir] = con
    return _CON[sf_dir]


SPARK_KIND = {"bigint": "int", "int": "INT32!", "double": "float", "string": "str", "timestamp": "ts", "date": "date", "boolean": "bool"}
DUCK_KIND = {"BIGINT": "int", "DOUBLE": "float", "VARCHAR": "str", "TIMESTAMP": "ts", "DATE": "date", "BOOLEAN": "bool"}


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(name: str, spark, sf_dir: str) -> str | None:
    """None when equal, else a description of the difference."""
    q = base.REGISTRY[name]
    df = base.run(name, spark, sf_dir)
    s_types = {f.name: SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    rows = df.collect()
    if q.sql is None:
        return None if rows else "no rows"
    con = duck(sf_dir)
    cur = con.execute(base.oracle(q.sql))
    d_cols = [c[0] for c in cur.description]
    d_types = {c[0]: DUCK_KIND.get(str(c[1]), str(c[1])) for c in cur.description}
    d_rows = cur.fetchall()
    if sorted(s_types) != sorted(d_cols):
        return f"columns differ: spark only {sorted(set(s_types) - set(d_cols))}, duckdb only {sorted(set(d_cols) - set(s_types))}"
    bad = {c: (s_types[c], d_types[c]) for c in s_types if s_types[c] != d_types[c]}
    cols = sorted(s_types)
    left = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)
    right = sorted((tuple(norm(r[d_cols.index(c)]) for c in cols) for r in d_rows), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; types {bad}"
    for a, b in zip(left, right):
        if a != b:
            diff = {c: (x, y) for c, x, y in zip(cols, a, b) if x != y}
            n = sum(1 for a, b in zip(left, right) if a != b)
            return f"{n}/{len(left)} rows differ, first: {diff} in {a}"
    if bad:
        return f"types differ {bad}"
    return None if left else "both empty"

"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        if name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def same(a, b, tol):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b and type(a) is type(b)


def compare(df, con, sql, tol=0.0):
    """None when equal, else a short description of the first difference."""
    rel = con.execute(sql)
    sql_columns = [d[0] for d in rel.description]
    sql_rows = rel.fetchall()
    mine = df.collect()
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    left = rows_of(df.columns, [tuple(r) for r in mine])
    right = rows_of(sql_columns, sql_rows)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right) if not all(same(x, y, tol) for x, y in zip(a, b))]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, columns {sorted(df.columns)}: {bad[0][0]} != {bad[0][1]}"
    if not left:
        return "no rows"
    return None

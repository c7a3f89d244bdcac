"""Run a query in Spark and its SQL in DuckDB and compare: names, row count, values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def difference(spark, function, sql: str, sf_dir: str) -> str:
    """Empty if both agree."""
    df = function(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    return next((f"{a} and {b}" for a, b in zip(mine, theirs) if a != b), "")

"""Compare queries with their SQL in DuckDB on the smallest test tables."""

import math
import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, f, sql):
    df = f(spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return
    assert "int" not in dict(df.dtypes).values(), df.dtypes
    db = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    rel = db.execute(sql)
    assert got == rows_of([c[0] for c in rel.description], rel.fetchall())

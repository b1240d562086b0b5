"""Runs a query and its SQL over the same tables and compares the rows."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, query, sql, folder=DATA):
    db = duckdb.connect()
    for p in Path(folder).iterdir():
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    there = db.execute(sql)
    want = rows([c[0] for c in there.description], there.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in there.description)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)

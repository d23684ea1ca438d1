"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def views(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"create view {name} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


def same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    rel = views(sf_dir).execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, rel.fetchall())
    assert len(a) == len(b)
    assert a == b
    return len(a)

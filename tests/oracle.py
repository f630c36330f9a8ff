"""Rows of a query against those of its DuckDB SQL."""

import glob
import os

import duckdb


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return str(v) if v.__class__.__name__ in ("Timestamp", "datetime", "date", "Decimal") else v


def rows_of(names, rows):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(plain(r[i]) for i in at) for r in rows], key=repr)


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}{'/*' if os.path.isdir(p) else ''}'")
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    ours, theirs = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs, next((a, b) for a, b in zip(ours, theirs) if a != b)

"""Runs a query and its SQL twin over the same tables and compares names and values, whatever the order."""

import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    return x


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in names)) for r in df.collect()))
    con = duck(sf_dir)
    con.execute(f"CREATE TABLE twin AS {sql}")
    columns = [r[0] for r in con.execute("SELECT column_name FROM information_schema.columns WHERE table_name = 'twin'").fetchall()]
    assert sorted(columns) == names, (sorted(columns), names)
    want = sorted(repr(tuple(plain(x) for x in r)) for r in con.execute(f"SELECT {', '.join(names)} FROM twin").fetchall())
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, wrong[:3]
    return len(got)

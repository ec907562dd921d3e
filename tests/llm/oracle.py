"""Compare a query with its SQL on the same tables."""

import glob
import os

import duckdb


def rows_of(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from read_parquet('{source}')")
    con.execute(sql)
    names = [c[0] for c in con.description]
    return sorted((tuple(row[names.index(n)] for n in sorted(names)) for row in con.fetchall()), key=repr), sorted(names)


def assert_same(frame, sql, sf_dir):
    want, names = rows_of(sql, sf_dir)
    assert sorted(frame.columns) == names
    got = sorted((tuple(row[n] for n in names) for row in frame.collect()), key=repr)
    assert got == want
    return got

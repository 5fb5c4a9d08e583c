"""Runs a query and its SQL side by side, as the driver does."""

import datetime
import glob
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def same(df, sql, sf_dir):
    got_rows, want = df.collect(), connect(sf_dir).sql(sql)
    names, columns = df.columns, want.columns
    assert sorted(names) == sorted(columns), (sorted(names), sorted(columns))
    order = [columns.index(c) for c in sorted(columns)]
    key = lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in got_rows), key=key)
    expected = sorted((tuple(plain(row[i]) for i in order) for row in want.fetchall()), key=key)
    assert len(got) == len(expected), (len(got), len(expected))
    for a, b in zip(got, expected, strict=True):
        assert a == b, (sorted(names), a, b)
    return len(got)

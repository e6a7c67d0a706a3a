"""Holds a query's result against its SQL in DuckDB on the same tables."""

import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark, query, sql, folder=FOLDER):
    """(rows only in Spark, rows only in DuckDB), each with repeats."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    ours = _sorted(tuple(_plain(r[c]) for c in columns) for r in frame.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = _sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    return [r for r in ours if r not in theirs] if ours != theirs else [], [r for r in theirs if r not in ours] if ours != theirs else [], len(ours), len(theirs)

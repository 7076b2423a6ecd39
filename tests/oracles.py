"""Compare a query's rows with DuckDB's, in any order."""

import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        at = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(df, con, sql):
    told = con.execute(sql)
    want = rows_of([d[0] for d in told.description], told.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]

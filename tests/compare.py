"""Order-insensitive comparison of a Spark result with DuckDB over the same Parquet files."""

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def assert_same(df, sql, sf_dir):
    cursor = connect(sf_dir).execute(sql)
    expected_columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(expected_columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(expected_columns, cursor.fetchall())
    assert got == want, f"only in Spark {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"

"""Compares a Spark result with DuckDB's for the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def assert_same(df, con, sql):
    other = con.execute(sql)
    columns = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(columns)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, other.fetchall())
    assert len(a) == len(b)
    assert not [p for p in zip(a, b, strict=True) if p[0] != p[1]][:3]

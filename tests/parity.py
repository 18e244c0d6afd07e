"""Compare a query with its DuckDB equivalent, as multisets of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(names, columns, rows):
    at = [columns.index(c) for c in names]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


def assert_parity(query, sql, spark, folder):
    df = query(spark, folder)
    rel = duck(folder).sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    assert rows_of(names, df.columns, df.collect()) == rows_of(names, rel.columns, rel.fetchall())

"""Spark's rows of a query against DuckDB's."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def assert_same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    assert {c: str(got[c].dtype) for c in cols} == {c: str(want[c].dtype) for c in cols}
    got, want = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert got.equals(want), got[(got != want).any(axis=1)].head()

"""The corpus queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from plumbline.llm import queries

DIR = "/root/testdata/sf0.001"


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    want = sorted(plain(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall())
    assert sorted(plain(r) for r in df.select(*columns).collect()) == want

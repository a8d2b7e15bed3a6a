"""The training-data queries that SQL can express, against DuckDB over small whole tables."""

import os

import duckdb
import pytest

from tidewright.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    order = sorted(got.columns)
    found = sorted(str(tuple(r[c] for c in order)) for r in got.collect())
    duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == order
    assert found == sorted(str(tuple(v[names.index(c)] for c in order)) for v in duck.fetchall())


def test_all_ten_and_the_pipeline():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}

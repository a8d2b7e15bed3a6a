"""Every query against its SQL in DuckDB, over the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tidewright import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(float(v), 6) if isinstance(v, decimal.Decimal | float) else v
    return sorted(names), sorted(str([plain(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in duck.description]
    assert found == rows(names, duck.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)

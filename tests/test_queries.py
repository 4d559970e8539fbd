"""Every registered query against its SQL in DuckDB, and the entry point."""

import os

import duckdb
import pytest

import __spark_entry__
from clauseloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = {k: __spark_entry__._reachable(f) for k, f in registry.queries().items()}, registry.oracle_sql()


def canon(v):
    if v is None or v != v:
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(canon, r)) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted(tuple(map(canon, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

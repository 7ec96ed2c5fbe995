"""Every query that SQL can express gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.roles import TABLES

CORE = {k: v for k, v in entry.queries().items() if k in entry.registry.queries()}


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(repr(float(x)) if isinstance(x, float) else repr(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(set(CORE) & set(entry.registry.oracles())))
def test_oracle(spark, db, sf, name):
    got, want = CORE[name](spark, sf).toPandas(), db.execute(entry.registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

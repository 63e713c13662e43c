"""Every registered query with SQL against DuckDB on the shared tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from mnemoria.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if x is None or x != x else str(x) if hasattr(x, "isoformat") else x
    return sorted(repr([plain(x) for x in r]) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE:
        assert len(got)
        return
    want = con.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert 1 <= entry.entry(spark).count() <= 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

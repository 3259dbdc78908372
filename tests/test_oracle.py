"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from ludex.plans.catalog import OPERATORS, ORACLE, QUERIES
from scripts.oracle_check import TABLES, rows


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_documents_its_operators():
    assert set(OPERATORS) == set(QUERIES) <= set(E.queries())
    assert set(ORACLE) <= set(QUERIES)
    assert set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.sql(ORACLE[name]).df()
    c1, r1 = rows(got)
    c2, r2 = rows(want)
    assert c1 == c2
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["app_id", "game_name", "mean_relevance", "n_users"]
    assert df.count() == 10

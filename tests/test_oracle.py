"""Every registered query against its SQL on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def database(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, database):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(database.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(name, spark, sf_dir):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found) > 0 and len(found.columns) > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)

"""Every registered query against its SQL, and a check that the registry is whole."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()
SLOW = {"game_linkage", "game_inference", "game_utility"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 1215


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0

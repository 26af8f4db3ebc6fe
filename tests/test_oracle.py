"""Every registered query against its SQL."""

import pytest
from oracle_check import connect, difference

import __spark_entry__ as contract
from martlens.registry import all_queries
from martlens_oracle import oracle_queries

QUERIES = all_queries()
SQL = oracle_queries()


@pytest.fixture(scope="module")
def raw(sf001):
    return connect(sf001)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 10


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, raw, sf001, name):
    assert difference(QUERIES[name](spark, sf001), raw, SQL[name]) is None

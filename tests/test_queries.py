import pytest
from check_queries import compare, duck

import __spark_entry__ as entry
from quotemill import queries as registered

NAMES = sorted(registered.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    """Queries of the llm subpackage, where it is present, have tests of their own."""
    assert set(NAMES) == set(registered.oracle_sql()) <= set(entry.oracle_sql())
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    problem, n = compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert not problem
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

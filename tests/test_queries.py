"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_queries import DATA, connect, differences


# Both sides agree on no rows at the smallest scale: it has fewer documents than vectors.
EMPTY_HERE = {"missing_vectors", "unknown_knowledge_ids"}


@pytest.fixture(scope="module")
def connection():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, connection, name):
    problem = differences(spark, DATA, name, connection)
    assert problem == "" or (problem == "no rows" and name in EMPTY_HERE)


def test_entry(spark):
    assert contract.entry(spark).count() == 30


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

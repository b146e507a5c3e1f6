"""Every registered query against its SQL, and the contract of the entry module."""

import pytest
from conftest import SF
from oracle import compare, connect

import __spark_entry__ as contract
from loomtable import catalog

catalog.load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


# At the smallest scale the most connected item pairs may be missing, nothing else.
MAY_BE_EMPTY = {"item_pairs_cosine", "other_side_of_pairs", "similar_items_for_one", "busy_customers"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    problems = compare(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "empty result"]
    assert not problems


def test_contract(spark):
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 10

"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks.compare import difference, expected
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_is_a_page(spark):
    assert contract.entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = contract.queries()[name](spark, SF)
    assert difference(df.columns, df.collect(), *expected(SF, contract.oracle_sql()[name])) is None

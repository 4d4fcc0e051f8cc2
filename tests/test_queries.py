"""Every registered query against its SQL on the smallest data."""

import compare
import pytest
from conftest import DATA

import __spark_entry__ as entry
from railbird.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    ok, message = compare.compare(spark, con, DATA, name)
    assert ok, message


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

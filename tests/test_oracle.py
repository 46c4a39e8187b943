"""Every query with an SQL check, on the smallest supplied tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF) is None


def test_checks_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0

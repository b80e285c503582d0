"""Every registered query against its SQL on the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import check_queries
import oracles
import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check_queries.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(registry.build()) == set(oracles.build())


def test_the_contract_holds_all_queries():
    assert set(registry.build()) <= set(contract.queries())
    assert set(oracles.build()) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registry.build()))
def test_query_agrees_with_sql(spark, connection, name):
    assert check_queries.compare(spark, connection, SF_DIR, name) is None


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["transition", "source_event", "target_event", "transition_count"]
    assert frame.count() > 0

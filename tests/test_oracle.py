"""Every query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from murmur.plans.oracle import ORACLE
from murmur.plans.queries import QUERIES
from oracle_check import compare, connect



@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_registry():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    metrics = entry.entry(spark)
    assert metrics.count() == 20
    assert "total_avg" in metrics.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []

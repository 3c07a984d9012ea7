"""Every registered query against its SQL on the given tables."""

import pytest

import oracle
from lingotally.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert oracle.compare(QUERIES[name](spark, sf), con, ORACLE[name]) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())

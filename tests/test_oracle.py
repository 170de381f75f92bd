"""Every query with SQL gives the same rows in Spark and DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from panelcast.catalog import REGISTRY, SQL
from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"
QUICK = ["ar_select", "kmeans_fit"]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(SQL) + QUICK)
def test_same_rows(spark, con, key):
    problem, _, _ = difference(spark, con, SMALL, key, empty=True)
    assert problem is None


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() > 0
    assert len(REGISTRY) >= 116

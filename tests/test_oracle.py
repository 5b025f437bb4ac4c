"""Every registered query against its SQL twin on the smallest given tables."""

import pytest

import __spark_entry__ as registry
from check_oracle import compare, connect
from veilwork.plans.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    assert compare(spark, db, name, FOLDER) is None


def test_every_query_has_a_twin():
    assert set(CATALOG) <= set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    out = registry.entry(spark)
    assert out.columns == ["source", "kind", "n"] and out.count() > 0

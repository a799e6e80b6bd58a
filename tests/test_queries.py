"""Every registered query of the engine against its oracle, and that the registry is whole."""

import os

import pytest

import __spark_entry__
from quarry import registry

from .compare import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert len(registry.QUERIES) > 150


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) == ""

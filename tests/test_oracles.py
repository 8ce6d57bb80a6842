"""Every registered query against its SQL on the shared tables."""

import os

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("NATAL_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql().get(name), SF_DIR) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())

"""Every registered query equals its SQL on the smallest given tables."""

from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not mounted")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert compare(contract.QUERIES[name](spark, SF_DIR), connection, contract.ORACLES[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 199

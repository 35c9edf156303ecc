"""Every registered query against its DuckDB oracle (TEST_SF_DIR picks the scale)."""

import pytest

import __spark_entry__ as entry
from leakguard.plans.catalog import QUERIES
from oracles import ORACLES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir) == []

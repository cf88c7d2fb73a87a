"""Every catalogue query against its SQL in DuckDB, on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from pelage.plans import catalog  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)

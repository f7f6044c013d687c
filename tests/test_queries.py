"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
import catalog
from check import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.load()))
def test_query_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, catalog.load()[name], SF_DIR)
    assert ok, message


def test_entry_point(spark):
    assert entry_point.entry(spark).count() == 4
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())

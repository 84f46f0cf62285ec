"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, duck, name):
    problem = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert problem in ("", "no rows on either side"), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0

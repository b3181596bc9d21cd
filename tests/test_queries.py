"""Every registered query that has a SQL twin against it."""

import os

import pytest
from compare import database, difference

import __spark_entry__ as entry_module

FOLDER = os.environ.get("ZONEWISE_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# The training-data queries have tests of their own.
TWINNED = sorted(set(QUERIES) & set(ORACLES))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_library_query_has_a_twin():
    own = {name for group in entry_module.GROUPS for name in group.QUERIES}
    assert own <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", TWINNED)
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1

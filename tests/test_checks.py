"""Every registered query against its SQL on the shared tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import database, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Ten logs are too few to train on.
ROWS_DIR = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables not present")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, con, name):
    assert differences(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows(spark, name):
    assert queries()[name](spark, ROWS_DIR).count() > 0


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["dst_ip", "start_us", "end_us", "count"] and rows.count() == 3

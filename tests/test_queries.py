"""Every registered query against its SQL twin on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from sluice.plans.queries import QUERIES
from tests.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(con, entry.queries()[name](spark, SF), SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 3

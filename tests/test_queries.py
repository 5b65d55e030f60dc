"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as driver
from unitcal.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(CATALOG) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n, e in CATALOG.items() if e.sql))
def test_query_equals_sql(spark, con, name):
    problem = compare(CATALOG[name].run(spark, SF), con, CATALOG[name].sql, tol=1e-9)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(n for n, e in CATALOG.items() if not e.sql))
def test_query_without_sql_returns_rows(spark, name):
    assert CATALOG[name].run(spark, SF).count() > 0

"""Every registered query against its SQL (or for rows) on the smallest data set."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
# Empty at this scale: too few connected rows.
MAY_BE_EMPTY = {"random_baseline", "pending_deliveries", "customer_products"}


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    frame = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
        return
    problem = compare(frame, connection, sql)
    if problem == "no rows" and name in MAY_BE_EMPTY:
        return
    assert problem is None


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["week_start", "material_type", "value"]
    assert frame.count() > 0

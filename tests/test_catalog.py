"""Every registered query against its SQL."""

import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import connect, differences

# Pages in one site, or none that qualifies, at the smallest size.
MAY_BE_EMPTY = {"render_promotion", "low_yield_pages"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    n, found = differences(spark, con, sf, name)
    assert not found
    assert n > 0 or name in MAY_BE_EMPTY


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

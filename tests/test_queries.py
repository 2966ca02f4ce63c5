"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from anamnesis.plans import catalog
from tests.compare import check, duck

SMALL = os.environ.get("TEST_QUERY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


# These may find nothing on tables as small as this.
MAY_BE_EMPTY = {"h17_keyword"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, message, _ = check(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SMALL)
    assert ok or (name in MAY_BE_EMPTY and message == "0 rows equal"), message


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

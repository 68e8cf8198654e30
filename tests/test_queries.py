"""Every registered query against its SQL, on whole tables."""

import os

import pytest

import __spark_entry__ as wiring
from mapwise.registry import QUERIES
from tools.check import compare, connect

FOLDER = os.environ.get("MAPWISE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, engine, name):
    # Some results, such as revoked grants of very few users, are rightly empty on the smallest tables.
    assert compare(spark, engine, FOLDER, name) in ("", "equal but empty")


def test_every_query_has_sql():
    assert set(QUERIES) <= set(wiring.oracle_sql())


def test_entry_has_rows(spark):
    assert wiring.entry(spark).limit(1).count() == 1

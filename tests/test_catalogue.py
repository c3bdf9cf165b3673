"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from folioscope.plans import exchange, lifecycle  # noqa: F401  these add to the catalogue
from folioscope.plans.queries import QUERIES, SQL
from tests.differential import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        assert compare(got, con.sql(SQL[name]).df()) == ""
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every bound query against its SQL on the smallest tables."""

import os

import pytest

from tallywise.plans import load
from tests.compare import compare, duck

QUERIES, ORACLES = load()
SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) in (None, "no rows on either side")


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)

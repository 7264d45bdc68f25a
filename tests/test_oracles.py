"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import harness
from parityflow.suite import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = registry.oracles()


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    problem, _, _ = harness.compare(spark, con, registry.queries()[name], ORACLES.get(name), SF)
    assert problem is None, problem


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(registry.queries())

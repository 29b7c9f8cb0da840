"""Every registered series query against its SQL."""

import pytest

from pulsegrid.plans.queries import ORACLES, QUERIES

from .oracle import agrees, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    agrees(spark, con, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLES}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0

"""Every registered query of the engine's own operators against its SQL."""

import pytest

import oracle
from letterworks import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_is_its_sql(spark, con, name):
    oracle.compare(con, spark, catalog.queries()[name], catalog.oracles()[name], SF)


def test_all_operators_are_registered():
    numbers = {int(n[1:3]) for n in catalog.queries()}
    assert numbers == set(range(1, 100))

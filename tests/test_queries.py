"""Every query against its SQL twin at the smallest scale."""

import pytest

import oracle
from conftest import SF

from figcorpus.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, problems = oracle.compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert not problems, problems
    assert n > 0 or name in ORACLES


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)

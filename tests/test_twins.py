"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import connect, differences
from conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_twin(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert differences(got, duck.execute(ORACLES[name]).df()) == []
    else:
        assert len(got) > 0


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)

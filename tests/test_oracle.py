"""Every query beside its SQL, over whole tables."""

import pytest

from checks.compare_sql import connect, difference
from checks.oracle import all_sql
from checks.queries import all_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(all_sql()) == set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(spark, con, name, sf_dir) is None

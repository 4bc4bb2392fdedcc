import pytest

from compare import assert_same
from shelfwise.plans.oracle import oracle_sql
from shelfwise.plans.queries import queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert_same(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())

import pytest
from conftest import DATA, against_sql

from granary.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(spark, name):
    against_sql(spark, queries.queries()[name], oracles.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0

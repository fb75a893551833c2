"""Every bound query against its SQL twin on the smallest tables."""

import pytest

from placeloom.plans import queries as engine
from tests import oracle


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


#: Rankings by Arrow functions, which SQL can't express; test_operators compares them with plain code.
NO_SQL = {"autocomplete", "closest_names", "fuzzy_search_rank"}


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query(spark, data, con, name):
    oracle.same(engine.queries()[name](spark, data), con, engine.oracle_sql()[name])


def test_all_others_are_named():
    assert set(engine.queries()) - set(engine.oracle_sql()) == NO_SQL

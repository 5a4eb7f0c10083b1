"""Every query against its SQL; those without SQL by what has to hold."""

import pytest

from heddle.plans.registry import PLANS
from tests.conftest import SF


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql])
def test_query_equals_sql(spark, duck, same, name):
    same(PLANS[name].run(spark, SF), duck.sql(PLANS[name].sql))


def test_communities_lie_within_components(spark):
    parts = {r.id: r.component for r in PLANS["weak_components"].run(spark, SF).collect()}
    rows = PLANS["communities"].run(spark, SF).collect()
    assert {r.id for r in rows} == set(parts)
    assert all(r.community.split(":")[0] == parts[r.id] for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(PLANS) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())

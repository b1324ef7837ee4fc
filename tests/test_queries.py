"""Every registered query of the engine itself: against its SQL twin, or for a stable schema."""

import pytest

import __spark_entry__
from tests.compare import difference
from weftline.plans import registry

SMOKE = __spark_entry__.SMOKE


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SMOKE), registry.ORACLES[name], SMOKE) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_the_same_rows_twice(spark, name):
    first, second = (sorted(map(str, registry.QUERIES[name](spark, SMOKE).collect())) for _ in range(2))
    assert first == second and first


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

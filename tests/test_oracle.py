"""Every registered query against its SQL twin, and rules that all their plans keep."""

import __spark_entry__ as entry_module
import pytest

from tableloom import registry
from tests.conftest import SF, plan
from tests.oracle import compare, connect

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, con, ORACLES[name]) is None
    text = plan(df)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in text


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) > 10 and rows[0].asDict().keys() == {"country", "avg_age", "count_distinct_email", "max_age"}


def test_contract(spark):
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.queries()["scan_orders"](spark, SF).count() == 1500

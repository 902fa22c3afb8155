"""Registered queries against their SQL, and the shape of the others."""

import __spark_entry__ as entry_module
import pytest

from tableloom.llm import registry
from tests.conftest import SF, plan
from tests.oracle import compare, connect

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, con, ORACLES[name]) is None
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_all_thirteen_and_the_pipeline_are_registered():
    names = entry_module.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names

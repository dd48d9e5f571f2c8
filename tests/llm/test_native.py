"""Operators that are to use DataFrame functions only have no Python in their plans, and need no cross joins."""

import pytest

from tidemark.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_heavy_hitter_dedup", "op3_block_mixing", "op6_license_scan"])
def test_plan(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_and_its_sql(spark, name):
    ok, message, count, _ = compare(spark, connect(FOLDER), QUERIES[name], SQL.get(name), FOLDER)
    assert ok, message
    assert count

"""Every registered query against its SQL, and the contract's entry point."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from registry import load
from tests.compare import compare
from tests.conftest import SF_DIR, plan_of

NAMES = sorted(load()[0])


def test_every_query_has_sql():
    queries, sql = load()
    assert set(sql) == set(queries) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 150
    assert sum(1 for r in rows if r["description"]) == 100


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    # Nothing may pair all rows with all rows.
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    problem = compare(df, con, contract.oracle_sql()[name])
    assert problem is None, problem

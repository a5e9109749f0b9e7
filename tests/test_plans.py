"""What the plans of some registered queries must have; what none may have is in test_queries, where each is run."""

from __future__ import annotations

import os

import pytest

from trellis import catalog

TABLES = os.environ.get("TRELLIS_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "read", "unread"),
    [("summary_by_task", ["l_discount", "l_linenumber"], ["l_tax", "l_shipdate", "l_extendedprice", "l_orderkey"]), ("queue_status_pivot", ["o_orderkey", "o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_custkey"]), ("evaluation_progress", ["l_suppkey", "l_orderkey"], ["l_discount", "l_tax"])],
)
def test_only_needed_columns_are_read(spark, name, read, unread):
    plan = plan_of(catalog.QUERIES[name](spark, TABLES))
    schemas = " ".join(x.split("struct<")[1] for x in plan.split("ReadSchema: ")[1:])
    assert all(c in schemas for c in read) and not any(c + ":" in schemas for c in unread)


@pytest.mark.parametrize("name", ["pending_left_join", "confirmed_semi"])
def test_filters_reach_the_scan(spark, name):
    assert "PushedFilters: [In(o_orderstatus" in plan_of(catalog.QUERIES[name](spark, TABLES))

"""Every query with SQL must give the SQL's rows; every other query must give rows."""

import pytest

from flowlens.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
ARRAY_MODELS = {"softmax_separable", "network_beats_linear"}  # scored by Arrow batches


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    assert compare(df, duck, ORACLES[name]) == []
    plan = plan_of(df)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan or (name in ARRAY_MODELS and unwanted == "ArrowEvalPython"), plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_files(spark):
    lookup = plan_of(QUERIES["point_lookup"](spark, SMALL))
    assert "PushedFilters: [In(event_id" in lookup and "user_id" not in lookup.split("ReadSchema")[1]
    counts = plan_of(QUERIES["label_distribution"](spark, SMALL))
    assert "ReadSchema: struct<event_type:string>" in counts


def test_copies_meet_before_the_shuffle(spark):
    plan = plan_of(QUERIES["dedup_rows"](spark, SMALL))
    below = plan.split("Exchange hashpartitioning(label", 1)[1]
    assert "partial_min(row_id" in below


def test_contribution_reports_do_not_shuffle_rows(spark):
    for name in ("topk_contribution", "waterfall"):
        plan = plan_of(QUERIES[name](spark, SMALL)).split("Subquery")[0]
        assert "hashpartitioning" not in plan and "Window" not in plan


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert {r["attack_category"] for r in rows} == {"Normal", "Browse", "Trade", "Fault", "Unknown"}
    assert abs(sum(r["share_pct"] for r in rows) - 100) < 0.5

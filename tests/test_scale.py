"""Distributed forms against plain windows, with one key holding a third of the rows; plan shape."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quotaloom.functions.ordered import next_time, number_from_counts, rank_from_counts
from quotaloom.operators.commercial import implementation_status


@pytest.fixture(scope="module")
def skewed(spark):
    k = F.col("id")
    return spark.range(3000).select(
        k.alias("id"), F.when(k % 3 == 0, F.lit(0)).otherwise(k % 50).alias("key"), (F.round(F.rand(7) * 40) / 10).alias("value"),
        F.timestamp_add("MINUTE", (F.hash("id") % 20000).cast("int"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).alias("at"),
    ).persist()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_next_time_equals_lead(skewed):
    lead = F.lead("at").over(Window.partitionBy("key").orderBy("at", "id"))
    same(next_time(skewed, "key", "at", "id", "nxt").select("id", "nxt"), skewed.select("id", lead.alias("nxt")))


def test_ranks_equal_windows(skewed):
    whole = F.rank().over(Window.orderBy(F.desc("value")))
    parts = F.rank().over(Window.partitionBy("key").orderBy(F.desc("value")))
    same(rank_from_counts(skewed, "value", "r").select("id", "r"), skewed.select("id", whole.alias("r")))
    same(rank_from_counts(skewed, "value", "r", ("key",)).select("id", "r"), skewed.select("id", parts.alias("r")))
    order = [F.desc("value"), F.desc("id")]
    same(
        number_from_counts(skewed, order, "n", F.struct("value", F.floor(F.col("id") / 100))).select("id", "n"),
        skewed.select("id", F.row_number().over(Window.orderBy(*order)).alias("n")),
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


HEAVY = ("pipeline_health_summary", "pipeline_hygiene_alerts", "win_probability_scores", "rep_performance", "expansion_opportunities", "telemetry_summary", "deal_recommendations", "alert_history", "usage_daily", "invoices")


@pytest.mark.parametrize("name", HEAVY)
def test_no_products_and_no_python(tables, name):
    text = plan(tables[name])
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in text, word


def test_scan_is_pruned_and_filtered(tables):
    text = plan(tables["recent_product_events"])
    assert "props" not in text.split("ReadSchema")[1].split("\n")[0]
    text = plan(tables["sales_interventions"])
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_orderkey), Not(EqualTo(o_orderstatus,F))]" in text or "Not(EqualTo(o_orderstatus,F))" in text


def test_total_row_is_sum_of_parts(tables):
    rows = tables["pipeline_health_summary"].collect()
    by = lambda v: [r for r in rows if r["view_type"] == v]
    total = by("overall")[0]
    for view in ("by_forecast_category", "by_stage"):
        assert sum(r["deal_count"] for r in by(view)) == total["deal_count"]
        assert round(sum(r["total_amount"] for r in by(view)), 2) == total["total_amount"]


def test_result_does_not_depend_on_partitioning(spark, tables):
    from quotaloom.operators.pipeline import pipeline_health_summary

    df = tables["deal_health"]
    same(pipeline_health_summary(df.repartition(7)), pipeline_health_summary(df.orderBy(F.desc("amount")).coalesce(1)))


def test_stage_of_a_tenant_takes_one_aggregate(spark):
    """The feeds are grouped together: two joins whatever the number of feeds; no feed, nulls, late rows and repeated tenants."""
    day, at = dt.date(2001, 12, 31), lambda d: dt.datetime(2001, 12, d)
    settings = spark.createDataFrame([(k, f"c{k}", "t", day) for k in (1, 2, 3, 3, 4, 5, None)], "customer_id long, customer_name string, tier string, onboarded_at date")
    syncs = spark.createDataFrame([(1, "crm", "failed", at(3)), (1, "crm", "success", at(2)), (2, None, "success", at(1)), (4, "crm", None, at(1)), (None, "crm", "success", at(1)), (5, "crm", "success", dt.datetime(2002, 1, 1))], "customer_id long, sync_type string, status string, last_sync_at timestamp_ntz")
    boards = spark.createDataFrame([(3, "pipeline_health_dashboard", at(1)), (3, "pipeline_hygiene_dashboard", at(1)), (3, "pipeline_hygiene_dashboard", at(2)), (2, "forecasting_dashboard", at(1)), (2, "coaching", at(1)), (2, None, at(1))], "customer_id long, feature_name string, usage_timestamp timestamp_ntz")
    agents = spark.createDataFrame([(2, None, at(1)), (4, "rebuild", at(5)), (4, None, at(6))], "customer_id long, action_type string, executed_at timestamp_ntz")
    gone = spark.createDataFrame([(2, True, True), (4, True, False), (4, True, None)], "customer_id long, go_live_approved boolean, cs_handoff_complete boolean")
    out = implementation_status(settings, syncs, boards, agents, gone, as_of=day)
    names = ("customer_id", "current_stage", "crm_connected", "first_sync_complete", "last_sync_at", "dashboards_enabled_count", "ops_agent_enabled", "agent_first_action", "total_agent_actions", "last_agent_action_at")
    assert sorted(map(tuple, out.select(*names).collect()), key=str) == sorted([
        (1, "connector_setup", True, True, at(3), 0, False, False, 0, None),
        (2, "live", False, False, at(1), 1, True, False, 1, at(1)),
        (3, "dashboard_config", False, False, None, 2, False, False, 0, None),
        (3, "dashboard_config", False, False, None, 2, False, False, 0, None),
        (4, "agent_training", True, False, at(1), 0, True, True, 2, at(6)),
        (4, "agent_training", True, False, at(1), 0, True, True, 2, at(6)),
        (5, "onboarding", False, False, None, 0, False, False, 0, None),
        (None, "onboarding", False, False, None, 0, False, False, 0, None),
    ], key=str)
    assert sum("Join " in line for line in plan(out).splitlines()) == 2

"""A cross-section of the registered queries against DuckDB; check.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import canon, kind
from quotaloom.plans.registry import BASE_TABLES, JOBS

SF_SQL = "/root/testdata/sf0.01"

NAMES = (
    "deal_health", "pipeline_health_summary", "pipeline_hygiene_alerts", "process_bottlenecks", "forecast_confidence", "forecast_history", "win_probability_scores",
    "scenario_summary", "rep_performance", "driver_comparisons", "hiring_impact_model", "expansion_opportunities", "qbr_executive_summary", "deal_scores", "churn_scores",
    "staging_b_activities", "staging_opportunities_incremental", "synced_deals", "implementation_history", "tenant_health_trends", "go_live", "impact_tracker", "ramp_step_in_force", "unified_timeline", "usage_summary", "alert_history", "ops_agent_queue", "invoices",
    "merged_opportunities", "merged_accounts", "account_matches", "active_users_calendar", "lead_touches", "deal_recommendations", "expansion_opportunities", "alert_rule_events",
    "sql_rep_leaderboard", "sql_month_quota_share", "sql_recently_updated_deals", "sql_commit_change", "sql_week_build_success", "webhook_failure_state", "quality_opportunities", "contract_violations", "sql_health_weighted_forecast",
)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SQL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF_SQL)
    cols = sorted(df.columns)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert {c: kind(df.schema[c].dataType.simpleString()) for c in cols} == {c: kind(t) for c, t in sorted(zip(rel.columns, rel.types))}
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = lambda data: sorted((tuple(canon(v) for v in r) for r in data), key=key)
    assert rows(df.select(*[f"`{c}`" for c in cols]).collect()) == rows(rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_query_has_sql_or_is_metadata():
    missing = (set(entry.queries()) & set(JOBS)) - set(entry.oracle_sql())
    assert missing <= {"table_profile", "schema_drift_alerts", "config_agent_status"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10

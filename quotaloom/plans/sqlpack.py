"""Report queries as parameterised Spark SQL over named tables.

Values are bound as named parameters and tables as DataFrames; nothing is
spliced into the text.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.exprs import in_quarter, quarter_bounds
from quotaloom.plans.registry import JOBS


def usd(x: str = "amount", where: str | None = None) -> str:
    filtered = f"sum(CAST(round({x} * 100) AS BIGINT)) FILTER (WHERE {where})" if where else f"sum(CAST(round({x} * 100) AS BIGINT))"
    return f"coalesce({filtered}, 0) / 100D"


@dataclass(frozen=True)
class Report:
    sql: str
    tables: tuple[str, ...] = ("deal_health",)
    args: tuple[str, ...] = field(default=())


OPEN = "stage_name NOT IN ('Closed Won', 'Closed Lost')"
BAND = "CASE WHEN health_score >= 80 THEN 'Healthy' WHEN health_score >= 60 THEN 'Monitor' WHEN health_score >= 40 THEN 'At Risk' ELSE 'Critical' END"
IN_QUARTER = "close_date BETWEEN :quarter_start AND :quarter_end"
QUARTER = ("quarter_start", "quarter_end")

REPORTS = {
    "sql_forecast_summary": Report(
        f"SELECT {usd(where="stage_name = 'Closed Won'")} AS closed_won, {usd(where="forecast_category = 'Commit' AND stage_name <> 'Closed Won'")} AS commit_open, "
        f"{usd(where="forecast_category = 'Best Case'")} AS best_case, {usd(where="forecast_category = 'Pipeline'")} AS pipeline FROM {{deal_health}} WHERE {IN_QUARTER}",
        args=QUARTER,
    ),
    "sql_quarter_win_rate": Report(
        "SELECT count_if(stage_name = 'Closed Won') AS wins, count_if(stage_name = 'Closed Lost') AS losses, "
        f"round(count_if(stage_name = 'Closed Won') * 100D / nullif(count(*), 0), 1) AS win_rate_pct FROM {{deal_health}} WHERE {IN_QUARTER} AND stage_name IN ('Closed Won', 'Closed Lost')",
        args=QUARTER,
    ),
    "sql_health_distribution": Report(
        f"SELECT {BAND} AS health_band, count(*) AS deal_count, {usd()} AS total_amount, round(avg(health_score), 1) AS avg_health FROM {{deal_health}} WHERE NOT is_closed GROUP BY 1 ORDER BY avg_health DESC"
    ),
    "sql_hero_deals": Report(
        "SELECT opportunity_name, account_name, amount, stage_name, forecast_category, health_score, days_in_current_stage, datediff(:today, last_activity_date) AS days_quiet, stakeholder_count, has_champion "
        "FROM {deal_health} WHERE is_hero_deal AND NOT is_closed ORDER BY health_score, opportunity_name",
        args=("today",),
    ),
    "sql_at_risk_commit": Report(
        f"SELECT account_name, opportunity_id, amount, health_score, {BAND} AS health_status, owner_name, days_in_current_stage FROM {{deal_health}} "
        "WHERE forecast_category = 'Commit' AND NOT is_closed AND health_score < 70 ORDER BY amount DESC"
    ),
    "sql_reps_by_win_rate": Report("SELECT rep_name, avg_stakeholders, win_rate, ytd_attainment FROM {sales_reps} ORDER BY win_rate DESC, rep_name", ("sales_reps",)),
    "sql_win_rate_by_stakeholders": Report(
        "SELECT CASE WHEN stakeholder_count >= 4 THEN '4+ stakeholders' WHEN stakeholder_count >= 3 THEN '3 stakeholders' WHEN stakeholder_count >= 2 THEN '2 stakeholders' ELSE '1 stakeholder' END AS bucket, "
        "count_if(is_won) AS wins, count_if(NOT is_won) AS losses, round(count_if(is_won) * 100D / nullif(count(*), 0), 1) AS win_rate_pct FROM {deal_health} WHERE is_closed GROUP BY 1"
    ),
    "sql_rep_comparison": Report(
        "SELECT rep_name, round(win_rate * 100, 4) AS win_rate_pct, avg_stakeholders, avg_sales_cycle_days, round(ytd_attainment * 100, 4) AS attainment_pct, activities_this_month FROM {sales_reps} WHERE segment = :segment",
        ("sales_reps",), ("segment",),
    ),
    "sql_competitor_losses": Report(
        f"SELECT competitor_mentioned, count(*) AS deals_lost, {usd()} AS revenue_lost, array_join(array_sort(collect_set(loss_reason)), ', ') AS loss_reasons FROM {{deal_health}} "
        "WHERE stage_name = 'Closed Lost' AND competitor_mentioned IS NOT NULL GROUP BY competitor_mentioned"
    ),
    "sql_loss_reasons": Report(
        f"SELECT loss_reason, count(*) AS count, {usd()} AS total_amount, round(count(*) * 100D / sum(count(*)) OVER (), 1) AS pct_of_losses FROM {{deal_health}} WHERE loss_reason IS NOT NULL GROUP BY loss_reason"
    ),
    "sql_stage_duration": Report(
        "SELECT activity, count(*) AS occurrences, round(avg(duration_days), 1) AS avg_duration, benchmark_days AS target_duration, round(avg(deviation_days), 1) AS avg_deviation, count_if(is_bottleneck) AS bottleneck_count "
        "FROM {process_events} GROUP BY activity, benchmark_days",
        ("process_events",),
    ),
    "sql_stuck_in_legal": Report(
        "SELECT o.opportunity_id, o.account_name, o.amount, o.owner_name, e.event_id, e.duration_days AS days_in_legal, e.benchmark_days AS target_days, e.deviation_days AS days_over "
        "FROM {deal_health} o JOIN {process_events} e ON o.opportunity_id = e.case_id WHERE e.activity = 'Legal Review' AND NOT o.is_closed AND e.duration_days > 7",
        ("deal_health", "process_events"),
    ),
    "sql_rework_list": Report("SELECT case_id, event_id, amount, activity AS repeated_stage, resource AS rep FROM {process_events} WHERE is_rework", ("process_events",)),
    "sql_rep_scoreboard": Report(
        "SELECT rep_name, manager_name, region, round(ytd_attainment * 100, 0) AS attainment_pct, round(win_rate * 100, 0) AS win_rate_pct, avg_stakeholders, deals_in_pipeline FROM {sales_reps} WHERE ytd_attainment < :below",
        ("sales_reps",), ("below",),
    ),
    "sql_manager_rollup": Report(
        "SELECT manager_name, region, count(*) AS team_size, round(sum(CAST(round(ytd_attainment * 100) AS BIGINT)) / count(*), 0) AS avg_team_attainment, "
        f"round(sum(CAST(round(win_rate * 100) AS BIGINT)) / count(*), 0) AS avg_team_win_rate, {usd('current_pipeline')} AS team_pipeline, count_if(ytd_attainment < 0.70D) AS reps_at_risk FROM {{sales_reps}} GROUP BY manager_name, region",
        ("sales_reps",),
    ),
    "sql_health_weighted_forecast": Report(
        f"SELECT forecast_category, count(*) AS deals, {usd()} AS raw_amount, sum(CAST(round(amount * CASE WHEN health_score >= 80 THEN 1.0D WHEN health_score >= 60 THEN 0.85D WHEN health_score >= 40 THEN 0.60D ELSE 0.30D END * 10000) AS BIGINT)) / 10000D AS health_adjusted, "
        "round(avg(health_score), 0) AS avg_health FROM {deal_health} WHERE NOT is_closed AND close_date <= :quarter_end GROUP BY forecast_category",
        args=("quarter_end",),
    ),
    "sql_row_counts": Report(
        "SELECT 'Opportunities' AS dataset, count(*) AS records FROM {deal_health} UNION ALL SELECT 'Sales Reps', count(*) FROM {sales_reps} UNION ALL SELECT 'Process Events', count(*) FROM {process_events}",
        ("deal_health", "sales_reps", "process_events"),
    ),
    "sql_stale_tables": Report("SELECT customer_id, dataset_path, last_build_ts, status FROM {build_metrics} WHERE last_build_ts < CAST(:now AS TIMESTAMP_NTZ) - INTERVAL 2 HOURS", ("build_metrics",), ("now",)),
    "sql_open_commit": Report(f"SELECT {usd(where="forecast_category = 'Commit'")} AS commit_value, {usd(where="forecast_category IN ('Commit', 'Best Case')")} AS best_case_value, {usd()} AS open_value, count(*) AS open_deals FROM {{deal_health}} WHERE {OPEN}"),
    "sql_month_attainment": Report(
        f"SELECT {usd(where="stage_name = 'Closed Won'")} AS closed_won, (SELECT {usd('quota_amount')} FROM {{quotas}}) AS quota FROM {{deal_health}} WHERE close_date >= date_trunc('month', :today) AND close_date <= :today",
        ("deal_health", "quotas"), ("today",),
    ),
    "sql_ninety_day_results": Report(
        f"SELECT round(100D * count_if(is_won) / nullif(count(*), 0), 1) AS win_rate, round({usd(where='is_won')} / nullif(count_if(is_won), 0), 4) AS avg_won_deal FROM {{deal_health}} WHERE is_closed AND close_date >= date_sub(:today, 90)",
        args=("today",),
    ),
    "sql_funnel_by_stage": Report(
        f"SELECT d.stage_name, min(b.stage_order) AS stage_order, count(*) AS count, {usd('d.amount')} AS value FROM (SELECT stage_name, amount FROM {{opportunities}} WHERE {OPEN}) d "
        "JOIN {stage_benchmarks} b ON d.stage_name = b.stage_name GROUP BY d.stage_name ORDER BY min(b.stage_order)",
        ("opportunities", "stage_benchmarks"),
    ),
    "sql_pipeline_by_close_month": Report(f"SELECT CAST(date_trunc('month', close_date) AS DATE) AS month, {usd()} AS value FROM {{deal_health}} WHERE {OPEN} AND close_date >= :today GROUP BY 1", args=("today",)),
    "sql_newest_open_deals": Report(f"SELECT opportunity_id, opportunity_name, account_name, stage_name, amount, close_date, owner_name FROM {{deal_health}} WHERE {OPEN} ORDER BY created_date DESC, opportunity_id LIMIT 10"),
    "sql_recent_builds": Report("SELECT dataset_path, build_id, status, duration_seconds, error_message FROM {build_log} WHERE build_timestamp > CAST(:now AS TIMESTAMP_NTZ) - INTERVAL 24 HOURS AND build_timestamp < CAST(:now AS TIMESTAMP_NTZ)", ("build_log",), ("now",)),
    "sql_sla_overview": Report("SELECT customer_id, build_success_rate, freshness_rate, overall_sla_met FROM {sla_tracking}", ("sla_tracking",)),
    "sql_user_access": Report("SELECT build_id, dataset_path, build_timestamp FROM {build_log} WHERE customer_id = :user AND build_timestamp > CAST(:now AS TIMESTAMP_NTZ) - INTERVAL 30 DAYS", ("build_log",), ("user", "now")),
    "sql_forecast_snapshots": Report("SELECT snapshot_date, closed_won, commit_amount, ai_forecast, target FROM {forecast_history} WHERE snapshot_date >= date_sub(:today, 180)", ("forecast_history",), ("today",)),
    "sql_rep_attainment_list": Report("SELECT rep_name, quota, closed_won, commit, attainment FROM {rep_attainment}", ("rep_attainment",)),
    "sql_rep_leaderboard": Report(
        "SELECT rep_name, region, round(ytd_attainment * 100, 0) AS attainment_pct, round(win_rate * 100, 0) AS win_rate_pct, avg_stakeholders, avg_sales_cycle_days, current_pipeline FROM {sales_reps} ORDER BY ytd_attainment DESC, rep_id",
        ("sales_reps",),
    ),
    "sql_month_quota_share": Report(
        f"SELECT round(100D * {usd(where="stage_name = 'Closed Won'")} / nullif((SELECT {usd('quota_amount')} FROM {{quotas}}), 0), 2) AS attainment_pct FROM {{deal_health}} WHERE close_date >= date_trunc('month', :today) AND close_date <= :today",
        ("deal_health", "quotas"), ("today",),
    ),
    "sql_recently_updated_deals": Report(
        f"SELECT opportunity_id, opportunity_name, account_name, stage_name, amount, close_date, owner_name, last_modified_date FROM {{staging_opportunities}} WHERE {OPEN} ORDER BY last_modified_date DESC, opportunity_id LIMIT 10",
        ("staging_opportunities",),
    ),
    "sql_commit_change": Report(
        "SELECT snapshot_date, commit_amount, previous, commit_amount - previous AS change FROM (SELECT snapshot_date, commit_amount, lag(commit_amount) OVER (ORDER BY snapshot_date) AS previous FROM {forecast_history}) ORDER BY snapshot_date DESC LIMIT 1",
        ("forecast_history",),
    ),
    "sql_week_build_success": Report(
        "SELECT customer_id, count(*) AS builds, round(count_if(status = 'SUCCEEDED') / count(*), 4) AS build_success_rate FROM {build_log} WHERE build_timestamp > CAST(:now AS TIMESTAMP_NTZ) - INTERVAL 7 DAYS AND build_timestamp < CAST(:now AS TIMESTAMP_NTZ) GROUP BY customer_id",
        ("build_log",), ("now",),
    ),
    "sql_contract_violations": Report("SELECT table, field, rule, violations FROM {contract_violations} WHERE violations > 0", ("contract_violations",)),
}


def default_args(as_of: dt.date) -> dict:
    first, last = quarter_bounds(as_of)
    return {
        "quarter_start": first, "quarter_end": last, "today": as_of, "now": dt.datetime.combine(as_of + dt.timedelta(days=1), dt.time()).isoformat(sep=" "),
        "segment": "Enterprise", "below": 0.70, "user": 8,
    }


def run_report(name: str, tables, as_of: dt.date, **args) -> DataFrame:
    report = REPORTS[name]
    bound = {**default_args(as_of), **args}
    frames = {t: tables[t] for t in report.tables}
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(report.sql, args={a: bound[a] for a in report.args}, **frames)


def read_view(df: DataFrame, as_of: dt.date | None = None, team: str | None = None, order: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Dashboard read: optional quarter and team filter, order and top-k limit."""
    if as_of is not None and "close_date" in df.columns:
        df = df.filter(in_quarter(as_of, "close_date"))
    if team is not None:
        df = df.filter(F.col("manager_name") == F.lit(team))
    if order:
        df = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])
    return df if limit is None else df.limit(limit)


def _register(name: str) -> None:
    def report(tables, *, as_of) -> DataFrame:
        return run_report(name, tables, as_of)

    report.__name__ = name
    JOBS[name] = report


for _name in REPORTS:
    _register(_name)

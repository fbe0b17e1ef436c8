from oracles import N, RD, S, oracle
from quotaloom.plans.quality import BANDS, CATEGORIES, CONTRACTS, STAGES

OPEN = "stage_name NOT IN ('Closed Won','Closed Lost')"
IN_Q = "close_date BETWEEN DATE '2001-10-01' AND DATE '2001-12-31'"
BAND = "CASE WHEN health_score>=80 THEN 'Healthy' WHEN health_score>=60 THEN 'Monitor' WHEN health_score>=40 THEN 'At Risk' ELSE 'Critical' END"
END = "($AS_OF + 1)::TIMESTAMP"
oracle("sql_forecast_summary", f"""SELECT {S("amount", "is_won")} AS closed_won, {S("amount", "forecast_category='Commit' AND NOT is_won")} AS commit_open, {S("amount", "forecast_category='Best Case'")} AS best_case, {S("amount", "forecast_category='Pipeline'")} AS pipeline FROM deal_health WHERE {IN_Q}""")
oracle("sql_quarter_win_rate", f"""SELECT {N("is_won")} AS wins, {N("NOT is_won")} AS losses, round({N("is_won")}*100.0/count(*),1) AS win_rate_pct FROM deal_health WHERE {IN_Q} AND is_closed""")
oracle("sql_health_distribution", f"SELECT {BAND} AS health_band, count(*) AS deal_count, {S('amount')} AS total_amount, round(avg(health_score),1) AS avg_health FROM deal_health WHERE NOT is_closed GROUP BY 1")
oracle("sql_hero_deals", "SELECT opportunity_name, account_name, amount, stage_name, forecast_category, health_score, days_in_current_stage, ($AS_OF-last_activity_date)::INT AS days_quiet, stakeholder_count, has_champion FROM deal_health WHERE is_hero_deal AND NOT is_closed")
oracle("sql_at_risk_commit", f"SELECT account_name, opportunity_id, amount, health_score, {BAND} AS health_status, owner_name, days_in_current_stage FROM deal_health WHERE forecast_category='Commit' AND NOT is_closed AND health_score<70")
oracle("sql_reps_by_win_rate", "SELECT rep_name, avg_stakeholders, win_rate, ytd_attainment FROM sales_reps")
oracle("sql_win_rate_by_stakeholders", f"SELECT CASE WHEN stakeholder_count>=4 THEN '4+ stakeholders' WHEN stakeholder_count>=3 THEN '3 stakeholders' WHEN stakeholder_count>=2 THEN '2 stakeholders' ELSE '1 stakeholder' END AS bucket, {N('is_won')} AS wins, {N('NOT is_won')} AS losses, round({N('is_won')}*100.0/count(*),1) AS win_rate_pct FROM deal_health WHERE is_closed GROUP BY 1")
oracle("sql_rep_comparison", "SELECT rep_name, round(win_rate*100,4) AS win_rate_pct, avg_stakeholders, avg_sales_cycle_days, round(ytd_attainment*100,4) AS attainment_pct, activities_this_month FROM sales_reps WHERE segment='Enterprise'")
oracle("sql_competitor_losses", f"SELECT competitor_mentioned, count(*) AS deals_lost, {S('amount')} AS revenue_lost, string_agg(DISTINCT loss_reason, ', ' ORDER BY loss_reason) AS loss_reasons FROM deal_health WHERE stage_name='Closed Lost' AND competitor_mentioned IS NOT NULL GROUP BY 1")
oracle("sql_loss_reasons", f"SELECT loss_reason, count(*) AS count, {S('amount')} AS total_amount, round(count(*)*100.0/sum(count(*)) OVER (),1) AS pct_of_losses FROM deal_health WHERE loss_reason IS NOT NULL GROUP BY 1")
oracle("sql_stage_duration", f"SELECT activity, count(*) AS occurrences, round(avg(duration_days),1) AS avg_duration, benchmark_days AS target_duration, round(avg(deviation_days),1) AS avg_deviation, {N('is_bottleneck')} AS bottleneck_count FROM process_events GROUP BY activity, benchmark_days")
oracle("sql_stuck_in_legal", "SELECT o.opportunity_id, account_name, o.amount, owner_name, event_id, duration_days AS days_in_legal, e.benchmark_days AS target_days, deviation_days AS days_over FROM deal_health o JOIN process_events e ON opportunity_id=case_id WHERE activity='Legal Review' AND NOT is_closed AND duration_days>7")
oracle("sql_rework_list", "SELECT case_id, event_id, amount, activity AS repeated_stage, resource AS rep FROM process_events WHERE is_rework")
oracle("sql_rep_scoreboard", "SELECT rep_name, manager_name, region, round(ytd_attainment*100,0) AS attainment_pct, round(win_rate*100,0) AS win_rate_pct, avg_stakeholders, deals_in_pipeline FROM sales_reps WHERE ytd_attainment<0.70")
oracle("sql_manager_rollup", f"SELECT manager_name, region, count(*) AS team_size, round(sum(round(ytd_attainment*100)::BIGINT)::DOUBLE/count(*),0) AS avg_team_attainment, round(sum(round(win_rate*100)::BIGINT)::DOUBLE/count(*),0) AS avg_team_win_rate, {S('current_pipeline')} AS team_pipeline, {N('ytd_attainment<0.70')} AS reps_at_risk FROM sales_reps GROUP BY 1,2")
oracle("sql_health_weighted_forecast", f"SELECT forecast_category, count(*) AS deals, {S('amount')} AS raw_amount, {S('amount*CASE WHEN health_score>=80 THEN 1.0 WHEN health_score>=60 THEN 0.85 WHEN health_score>=40 THEN 0.60 ELSE 0.30 END', None, 4)} AS health_adjusted, round(avg(health_score),0) AS avg_health FROM deal_health WHERE NOT is_closed AND close_date<=DATE '2001-12-31' GROUP BY 1")
oracle("sql_row_counts", "SELECT 'Opportunities' AS dataset, count(*) AS records FROM opportunities UNION ALL SELECT 'Sales Reps', count(*) FROM sales_reps UNION ALL SELECT 'Process Events', count(*) FROM process_events")
oracle("sql_stale_tables", f"SELECT customer_id, dataset_path, last_build_ts, status FROM build_metrics WHERE last_build_ts < {END} - INTERVAL 2 HOURS")
oracle("sql_open_commit", f"""SELECT {S("amount", "forecast_category='Commit'")} AS commit_value, {S("amount", "forecast_category IN ('Commit','Best Case')")} AS best_case_value, {S("amount")} AS open_value, count(*) AS open_deals FROM deal_health WHERE {OPEN}""")
oracle("sql_month_attainment", f"SELECT {S('amount', 'is_won')} AS closed_won, (SELECT {S('quota_amount')} FROM quotas) AS quota FROM deal_health WHERE close_date BETWEEN DATE '2001-12-01' AND $AS_OF")
oracle("sql_ninety_day_results", f"SELECT round(100.0*{N('is_won')}/count(*),1) AS win_rate, round({S('amount', 'is_won')}/{N('is_won')},4) AS avg_won_deal FROM deal_health WHERE is_closed AND close_date>=$AS_OF-90")
oracle("sql_funnel_by_stage", f"SELECT stage_name, min(stage_order) AS stage_order, count(*) AS count, {S('amount')} AS value FROM deal_health JOIN stage_benchmarks USING (stage_name) WHERE {OPEN} GROUP BY 1")
oracle("sql_pipeline_by_close_month", f"SELECT date_trunc('month', close_date)::DATE AS month, {S('amount')} AS value FROM deal_health WHERE {OPEN} AND close_date>=$AS_OF GROUP BY 1")
oracle("sql_newest_open_deals", f"SELECT opportunity_id, opportunity_name, account_name, stage_name, amount, close_date, owner_name FROM deal_health WHERE {OPEN} ORDER BY created_date DESC, opportunity_id LIMIT 10")
oracle("sql_recent_builds", f"SELECT dataset_path, build_id, status, duration_seconds, error_message FROM build_log WHERE build_timestamp > {END} - INTERVAL 24 HOURS AND build_timestamp < {END}")
oracle("sql_rep_leaderboard", "SELECT rep_name, region, round(ytd_attainment*100,0) AS attainment_pct, round(win_rate*100,0) AS win_rate_pct, avg_stakeholders, avg_sales_cycle_days, current_pipeline FROM sales_reps")
oracle("sql_month_quota_share", f"SELECT round(100.0*{S('amount', 'is_won')}/(SELECT {S('quota_amount')} FROM quotas),2) AS attainment_pct FROM deal_health WHERE close_date BETWEEN DATE '2001-12-01' AND $AS_OF")
oracle("sql_recently_updated_deals", f"SELECT opportunity_id, opportunity_name, account_name, stage_name, amount, close_date, owner_name, last_modified_date FROM staging_opportunities WHERE {OPEN} ORDER BY last_modified_date DESC, opportunity_id LIMIT 10")
oracle("sql_commit_change", "SELECT a.snapshot_date, a.commit_amount, b.commit_amount AS previous, a.commit_amount-b.commit_amount AS change FROM (SELECT * FROM forecast_history ORDER BY snapshot_date DESC LIMIT 1) a, (SELECT * FROM forecast_history ORDER BY snapshot_date DESC LIMIT 1 OFFSET 1) b")
oracle("sql_week_build_success", f"SELECT customer_id, count(*) AS builds, round(count(*) FILTER (WHERE status='SUCCEEDED')/count(*),4) AS build_success_rate FROM build_log WHERE build_timestamp > {END} - INTERVAL 7 DAYS AND build_timestamp < {END} GROUP BY 1")
oracle("sql_sla_overview", "SELECT customer_id, build_success_rate, freshness_rate, overall_sla_met FROM sla_tracking")
oracle("sql_user_access", f"SELECT build_id, dataset_path, build_timestamp FROM build_log WHERE customer_id=8 AND build_timestamp > {END} - INTERVAL 30 DAYS")
oracle("sql_forecast_snapshots", "SELECT snapshot_date, closed_won, commit_amount, ai_forecast, target FROM forecast_history WHERE snapshot_date >= $AS_OF - 180")
oracle("sql_rep_attainment_list", 'SELECT rep_name, quota, closed_won, "commit", attainment FROM rep_attainment')

_l = lambda vals: "(" + ",".join(f"'{v}'" for v in vals) + ")"
_c = lambda name, obs, ok: f"SELECT '{name}' AS \"check\", ({obs})::DOUBLE AS observed, ({ok}) AS passed"


def zero(name, where, table):
    return f"SELECT '{name}' AS \"check\", {N(where)}::DOUBLE AS observed, {N(where)}=0 AS passed FROM {table}"


oracle("quality_opportunities", " UNION ALL ".join([
    "SELECT 'row_count' AS \"check\", count(*)::DOUBLE AS observed, count(*)>=1 AS passed FROM opportunities",
    *[zero(f"no_nulls_{c}", f"{c} IS NULL", "opportunities") for c in ("opportunity_id", "amount", "close_date")], zero("positive_amount", "amount<0", "opportunities"),
    zero("values_in_stage_name", f"stage_name NOT IN {_l(STAGES)}", "opportunities"), f"SELECT 'null_rate_owner_id', {N('owner_id IS NULL')}/count(*), {N('owner_id IS NULL')}/count(*)<=0.05 FROM opportunities",
    "SELECT 'freshness_close_date', ($AS_OF-max(close_date))::DOUBLE, $AS_OF-max(close_date)<=30 FROM opportunities", zero("won_is_closed_won", "is_won AND stage_name<>'Closed Won'", "opportunities"),
    zero("closed_stage", f"is_closed AND {OPEN}", "opportunities"), zero("matches_opportunity_name", "NOT regexp_matches(opportunity_name,'^Deal [0-9]+$')", "opportunities"), zero("length_opportunity_name", "length(opportunity_name)>255", "opportunities"),
    "SELECT 'unique_opportunity_id', (count(*)-count(DISTINCT opportunity_id))::DOUBLE, count(*)=count(DISTINCT opportunity_id) FROM opportunities",
    "SELECT 'fk_account_id', count(*)::DOUBLE, count(*)=0 FROM opportunities WHERE account_id IS NOT NULL AND account_id NOT IN (SELECT account_id FROM accounts)",
    "SELECT 'fk_owner_id', count(*)::DOUBLE, count(*)=0 FROM opportunities WHERE owner_id IS NOT NULL AND owner_id NOT IN (SELECT rep_id FROM sales_reps)",
]))
oracle("quality_health", " UNION ALL ".join([
    "SELECT 'row_count' AS \"check\", count(*)::DOUBLE AS observed, count(*)>=1 AS passed FROM deal_health", *[zero(f"no_nulls_{c}", f"{c} IS NULL", "deal_health") for c in ("opportunity_id", "health_score", "health_category")],
    zero("in_range_health_score", "health_score<0 OR health_score>100", "deal_health"), zero("values_in_health_category", f"health_category NOT IN {_l(BANDS)}", "deal_health"),
]))
oracle("quality_forecast", " UNION ALL ".join([
    "SELECT 'row_count' AS \"check\", count(*)::DOUBLE AS observed, count(*)>=1 AS passed FROM forecast_confidence", *[zero(f"no_nulls_{c}", f"{c} IS NULL", "forecast_confidence") for c in ("category", "weighted_amount")],
    zero("positive_weighted_amount", "weighted_amount<0", "forecast_confidence"), zero("in_range_confidence_pct", "confidence_pct<0 OR confidence_pct>100", "forecast_confidence"),
]))


def _rules():
    for table, rules in CONTRACTS.items():
        for r in rules:
            yield table, r.name, "type", "error", "0::BIGINT"
            if r.required:
                yield table, r.name, "required", "error", N(f"{r.name} IS NULL")
            if r.low is not None:
                yield table, r.name, "range", "warning", N(f"{r.name}<{r.low} OR {r.name}>{r.high}")
            if r.allowed:
                yield table, r.name, "allowed", "warning", N(f"{r.name} NOT IN {_l(r.allowed)}")
            if r.longest:
                yield table, r.name, "length", "warning", N(f"length({r.name})>{r.longest}")
            if r.pattern:
                yield table, r.name, "pattern", "warning", N(f"NOT regexp_matches({r.name},'{r.pattern}')")


oracle("contract_violations", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{f}' AS field, '{r}' AS rule, '{lv}' AS level, {e} AS violations" + ("" if r == "type" else f" FROM {t}") for t, f, r, lv, e in _rules()))
oracle("sql_contract_violations", 'SELECT "table", field, rule, violations FROM contract_violations WHERE violations>0')

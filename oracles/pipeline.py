from oracles import SD, A, L, M, N, QUARTER_AS_OF, R, S, oracle

oracle("deal_health", f"""
SELECT *, {L("health_score", ">=", [(80, "Healthy"), (60, "Monitor"), (40, "At Risk")], "Critical")} AS health_category,
 health_score < 70 AND NOT is_closed AS needs_attention, {L("health_score", ">=", [(80, 1), (60, 2), (40, 3)], 4)} AS risk_level
FROM (SELECT *, coalesce(health_score_override, calculated_health_score)::DOUBLE AS health_score
 FROM (SELECT *, round(velocity_score*0.25 + activity_score*0.25 + stakeholder_score*0.25 + competition_score*0.15 + discount_score*0.10, 0) AS calculated_health_score
  FROM (SELECT o.*, b.expected_days AS benchmark_days, ($AS_OF - last_activity_date)::INT AS days_since_activity, coalesce(discount_percent, 0) AS discount_pct,
    {L("coalesce(days_in_current_stage/b.expected_days, 1)", "<=", [(0.5, 100), (1, 85), (1.5, 70), (2, 50), (3, 30)], 10)} AS velocity_score,
    {L("$AS_OF - last_activity_date", "<=", [(2, 100), (5, 85), (7, 70), (10, 50), (14, 30)], 10)} AS activity_score,
    least({L("stakeholder_count", ">=", [(5, 100), (4, 90), (3, 75), (2, 50)], 20)} + CASE WHEN has_champion THEN 10 ELSE 0 END, 100) AS stakeholder_score,
    CASE WHEN competitor_mentioned IS NULL OR competitor_mentioned='None' THEN 100 WHEN is_competitive=false THEN 90 ELSE 60 END AS competition_score,
    CASE WHEN coalesce(discount_percent,0)=0 THEN 100 WHEN discount_percent<=10 THEN 90 WHEN discount_percent<=15 THEN 80 WHEN discount_percent<=20 THEN 65
     WHEN discount_percent<=25 THEN 45 ELSE 25 END AS discount_score
   FROM opportunities o LEFT JOIN stage_benchmarks b USING (stage_name))))
""")

CLOSED = "stage_name IN ('Closed Won','Closed Lost')"
oracle("opportunity_health_scored", f"""
SELECT *, CASE WHEN stage_name='Closed Won' THEN 'Won' WHEN stage_name='Closed Lost' THEN 'Lost' WHEN health_score>=80 THEN 'Healthy'
  WHEN health_score>=60 THEN 'Monitor' WHEN health_score>=40 THEN 'At Risk' ELSE 'Critical' END AS health_category,
 list_filter([CASE WHEN stage_velocity_score<=10 THEN 'Stalled in stage' END, CASE WHEN activity_score<=5 THEN 'Gone dark' END,
  CASE WHEN stakeholder_score<=10 THEN 'Single-threaded' END,
  CASE WHEN competitive_score<=5 AND competitor_mentioned IS NOT NULL THEN 'Competitive pressure' END,
  CASE WHEN discount_score<=8 THEN 'Heavy discounting' END,
  CASE WHEN NOT has_champion AND probability>=0.4 THEN 'No champion identified' END], lambda x: x IS NOT NULL) AS risk_flags
FROM (SELECT *, stage_velocity_score+activity_score+stakeholder_score+competitive_score+discount_score AS health_score
 FROM (SELECT o.* EXCLUDE (days_to_close), CASE WHEN is_closed THEN 0 ELSE close_date - $AS_OF END::INT AS days_to_close,
   b.expected_days AS benchmark_days, ($AS_OF - last_activity_date)::INT AS days_since_activity,
   CASE WHEN {CLOSED} THEN 25 WHEN b.expected_days IS NULL THEN 12 WHEN days_in_current_stage<=b.expected_days THEN 25
    WHEN days_in_current_stage<=b.expected_days*1.5 THEN 18 WHEN days_in_current_stage<=b.expected_days*2 THEN 10
    WHEN days_in_current_stage<=b.expected_days*3 THEN 5 ELSE 0 END AS stage_velocity_score,
   CASE WHEN {CLOSED} THEN 25 WHEN $AS_OF-last_activity_date<=3 THEN 25 WHEN $AS_OF-last_activity_date<=7 THEN 20
    WHEN $AS_OF-last_activity_date<=14 THEN 12 WHEN $AS_OF-last_activity_date<=21 THEN 5 ELSE 0 END AS activity_score,
   CASE WHEN {CLOSED} THEN 20 WHEN stakeholder_count>=5 THEN 20 WHEN stakeholder_count>=4 THEN 17 WHEN stakeholder_count>=3 THEN 14 WHEN stakeholder_count>=2 THEN 10 ELSE 4 END AS stakeholder_score,
   CASE WHEN {CLOSED} OR competitor_mentioned IS NULL THEN 15 WHEN has_champion THEN 10 ELSE 5 END AS competitive_score,
   CASE WHEN {CLOSED} OR discount_percent=0 THEN 15 WHEN discount_percent<=10 THEN 12 WHEN discount_percent<=20 THEN 8 WHEN discount_percent<=30 THEN 4 ELSE 1 END AS discount_score
  FROM opportunities o LEFT JOIN stage_benchmarks b USING (stage_name)))
""")

oracle("enriched_accounts", f"""
SELECT *, CASE WHEN is_customer AND coalesce(account_win_rate,0)>=50 AND coalesce(open_pipeline,0)>0 THEN 'High' WHEN is_customer THEN 'Medium' ELSE 'Low' END AS expansion_potential_score
FROM (SELECT a.*, m.* EXCLUDE (account_id), {R("won_deals", "won_deals+lost_deals", 100, 1)} AS account_win_rate,
 CASE WHEN closed_won_amount>0 THEN a.created_date END AS customer_since, closed_won_amount>0 AS is_customer,
 {L("closed_won_amount", ">=", [(500000, "Strategic"), (100000, "Key"), (0.01, "Standard")], "Prospect")} AS account_tier
FROM accounts a LEFT JOIN (SELECT account_id, count(*) AS total_opportunities, {S("amount", "is_won")} AS closed_won_amount, {S("amount", "NOT is_closed")} AS open_pipeline,
 {A("amount", "is_won")} AS avg_won_deal_size, {N("is_won")} AS won_deals, {N("is_closed AND NOT is_won")} AS lost_deals, max(close_date) AS last_close_date
 FROM opportunities GROUP BY 1) m USING (account_id))
""")

oracle("enriched_users", f"""
WITH m AS (
SELECT r.*, o.* EXCLUDE (rep_id), t.* EXCLUDE (rep_id),
 (datediff('month', date_trunc('month', start_date), date_trunc('month', $AS_OF))
  + CASE WHEN day(start_date)=day($AS_OF) OR (last_day(start_date)=start_date AND last_day($AS_OF)=$AS_OF) THEN 0 ELSE (day($AS_OF)-day(start_date))/31.0 END) AS months
FROM sales_reps r
LEFT JOIN (SELECT owner_id AS rep_id, count(*) AS total_opportunities, {S("amount", "is_won")} AS closed_won_ytd, {S("amount", "NOT is_closed")} AS open_pipeline,
 {N("is_won")} AS deals_won, {N("is_closed AND NOT is_won")} AS deals_lost, {A("amount", "is_won")} AS avg_won_deal_size, avg(days_to_close) FILTER (WHERE is_closed) AS avg_sales_cycle
 FROM opportunities GROUP BY 1) o USING (rep_id)
LEFT JOIN (SELECT owner_id AS rep_id, count(*) AS total_activities_30d, count(DISTINCT activity_type) AS activity_types_used, max(activity_date) AS last_activity_date
 FROM activities GROUP BY 1) t USING (rep_id))
SELECT *, {L("coalesce(quota_attainment,0)", ">=", [(120, "Top Performer"), (100, "On Target"), (80, "Developing")], "Needs Attention")} AS performance_tier,
 coalesce(capacity_utilization,100)<90 AS has_capacity
FROM (SELECT m.* EXCLUDE (months), {R("deals_won", "deals_won+deals_lost", 100, 1)} AS user_win_rate, {R("coalesce(closed_won_ytd,0)", "quota", 100, 1)} AS quota_attainment,
 {R("coalesce(total_opportunities,0)", "max_deals", 100, 1)} AS capacity_utilization, round(months,4) AS tenure, months<6 AS is_ramping,
 CASE WHEN months<6 THEN round(months/6*100,0) ELSE 100.0 END AS ramp_progress, 'Sales Rep' AS user_type, true AS is_active FROM m)
""")

BLOCK = f"""count(*) AS deal_count, {S("amount")} AS total_amount, round(avg(health_score),1) AS avg_health,
 {S("amount", "health_category='Healthy'")} AS healthy_amount, {S("amount", "health_category='Monitor'")} AS monitor_amount,
 {S("amount", "health_category='At Risk'")} AS at_risk_amount, {S("amount", "health_category='Critical'")} AS critical_amount,
 {N("needs_attention")} AS deals_needing_attention"""
OPEN = "stage_name IN ('Prospecting','Discovery','Solution Design','Proposal','Negotiation','Verbal Commit')"
oracle("pipeline_health_summary", f"""
SELECT *, round(health_weighted_amount/total_amount,2) AS confidence_factor FROM (
SELECT *, round(healthy_amount*100/total_amount,1) AS healthy_pct, round((at_risk_amount+critical_amount)*100/total_amount,1) AS at_risk_pct,
 round(healthy_amount + monitor_amount*0.85 + at_risk_amount*0.60 + critical_amount*0.30, 0) AS health_weighted_amount
FROM (SELECT forecast_category, 'by_forecast_category' AS view_type, {BLOCK} FROM deal_health WHERE {OPEN} GROUP BY 1
 UNION ALL SELECT stage_name, 'by_stage', {BLOCK} FROM deal_health WHERE {OPEN} GROUP BY 1
 UNION ALL SELECT 'TOTAL', 'overall', {BLOCK} FROM deal_health WHERE {OPEN}))
""")

oracle("pipeline_summary", f"""
SELECT p.*, q.* EXCLUDE (owner_id), {R("total_pipeline", "quarterly_quota", empty=0)} AS coverage_ratio, {R("commit_amount", "quarterly_quota", empty=0)} AS commit_coverage,
 {R("healthy_pipeline", "quarterly_quota", empty=0)} AS healthy_coverage, {R("healthy_pipeline", "total_pipeline", empty=0)} AS pipeline_health_pct, {R("at_risk_pipeline", "total_pipeline", empty=0)} AS at_risk_pct
FROM (SELECT owner_id, owner_name, manager_id, manager_name, region, {S("amount")} AS total_pipeline, count(*) AS deal_count, {A("amount")} AS avg_pipeline_deal,
 {S("amount", "forecast_category='Commit'")} AS commit_amount, {S("amount", "forecast_category='Best Case'")} AS best_case_amount, {S("amount", "forecast_category='Pipeline'")} AS pipeline_amount,
 {S("amount", "health_category='Healthy'")} AS healthy_pipeline, {S("amount", "health_category='Monitor'")} AS monitor_pipeline, {S("amount", "health_category IN ('At Risk','Critical')")} AS at_risk_pipeline,
 {N("health_category='Healthy'")} AS healthy_count, {N("health_category='Monitor'")} AS monitor_count, {N("health_category IN ('At Risk','Critical')")} AS at_risk_count,
 {S("amount", "close_date <= date_trunc('quarter', $AS_OF) + INTERVAL 3 MONTHS")} AS closing_this_quarter, {S("amount*probability", None, 4)} AS weighted_pipeline,
 avg(health_score) AS avg_health_score, avg(days_to_close) AS avg_days_to_close
 FROM opportunity_health_scored WHERE NOT is_closed GROUP BY ALL) p
LEFT JOIN (SELECT rep_id AS owner_id, quarterly_quota, ytd_closed_revenue, segment AS rep_segment FROM sales_reps) q USING (owner_id)
""")

ALERT_ORDER = ["is_gone_dark", "is_stale_close_date", "is_overdue_commit", "is_missing_champion", "is_single_threaded", "is_stalled_stage", "is_missing_next_steps", "is_heavy_discount"]
ACTIONS = ["Immediate outreach required - contact has gone dark for 14+ days", "Update close date - current date has passed",
           "Risk to commit - health score low with close date approaching", "Identify and cultivate internal champion",
           "Multi-thread: engage additional stakeholders", "Deal stalled - review blockers and re-engage",
           "Schedule follow-up activity within 7 days", "Review discount approval - exceeds 20% threshold"]
pick = lambda vals, rest: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(ALERT_ORDER, vals)) + f" ELSE '{rest}' END"
oracle("pipeline_hygiene_alerts", f"""
SELECT opportunity_id, opportunity_name, account_name, owner_id, owner_name, amount, stage_name, close_date, health_score, hygiene_score,
 {L("hygiene_score", ">=", [(80, "Clean"), (60, "Minor Issues"), (40, "Needs Attention")], "Critical")} AS hygiene_category, violation_count,
 {", ".join(ALERT_ORDER)}, days_since_activity, days_until_close, days_in_current_stage, coalesce(stakeholder_count,1) AS stakeholder_count,
 coalesce(discount_percent,0) AS discount_percent, {pick([f[3:].upper() for f in ALERT_ORDER], "NONE")} AS primary_alert,
 {pick(["CRITICAL"] * 3 + ["HIGH"] * 2 + ["MEDIUM"] * 2 + ["LOW"], "NONE")} AS alert_severity, {pick(ACTIONS, "No action required")} AS recommended_action,
 $AS_OF AS evaluated_date
FROM (SELECT *, greatest(0.0, 100 - violation_count*12.5) AS hygiene_score FROM (SELECT *, ({" + ".join(f + "::INT" for f in ALERT_ORDER)})::INT AS violation_count
 FROM (SELECT d.* EXCLUDE (days_since_activity), ($AS_OF - t.last_touch)::INT AS days_since_activity, (close_date - $AS_OF)::INT AS days_until_close,
  close_date < $AS_OF AS is_stale_close_date, coalesce(stakeholder_count,1) <= 1 AS is_single_threaded,
  next_touch IS NULL OR next_touch - $AS_OF > 7 AS is_missing_next_steps, coalesce($AS_OF - last_touch >= 14, true) AS is_gone_dark,
  coalesce(NOT has_champion, false) AS is_missing_champion, coalesce(days_in_current_stage > coalesce(b.expected_days,14)*2, false) AS is_stalled_stage,
  coalesce(forecast_category='Commit' AND close_date - $AS_OF < 14 AND health_score < 70, false) AS is_overdue_commit, coalesce(discount_percent,0) > 20 AS is_heavy_discount
 FROM deal_health d LEFT JOIN (SELECT opportunity_id, max(activity_date) AS last_touch, min(activity_date) FILTER (WHERE activity_date > $AS_OF) AS next_touch
   FROM activities GROUP BY 1) t USING (opportunity_id) LEFT JOIN stage_benchmarks b USING (stage_name) WHERE NOT is_closed)))
""")

oracle("pipeline_hygiene_summary", f"""
SELECT count(*) AS total_opportunities, {", ".join(f"{N(f)} AS {f[3:]}_count" for f in ALERT_ORDER)},
 {", ".join(f"{N(f'''alert_severity='{s.upper()}' ''')} AS {s}_count" for s in ("critical", "high", "medium", "low"))},
 {N("hygiene_category='Clean'")} AS clean_count, {N("hygiene_category='Minor Issues'")} AS minor_issues_count, {N("hygiene_category='Needs Attention'")} AS needs_attention_count,
 {N("hygiene_category='Critical'")} AS critical_hygiene_count, {S("amount", "alert_severity='CRITICAL'")} AS critical_revenue_at_risk, {S("amount", "alert_severity='HIGH'")} AS high_revenue_at_risk,
 round(avg(hygiene_score),1) AS avg_hygiene_score, {N("alert_severity<>'NONE'")} AS total_alerts, $AS_OF AS evaluated_date
FROM pipeline_hygiene_alerts
""")

oracle("pipeline_hygiene_by_owner", f"""
SELECT *, CASE greatest(gone_dark_count, single_threaded_count, missing_champion_count, missing_next_steps_count)
 WHEN gone_dark_count THEN 'Engagement Consistency' WHEN single_threaded_count THEN 'Multi-Threading' WHEN missing_champion_count THEN 'Champion Development' ELSE 'Activity Planning' END AS primary_coaching_area
FROM (SELECT owner_id, owner_name, count(*) AS total_deals, round(avg(hygiene_score),1) AS avg_hygiene_score, sum(violation_count)::BIGINT AS total_violations,
 {N("alert_severity='CRITICAL'")} AS critical_alerts, {N("alert_severity='HIGH'")} AS high_alerts, {N("is_gone_dark")} AS gone_dark_count, {N("is_single_threaded")} AS single_threaded_count,
 {N("is_missing_champion")} AS missing_champion_count, {N("is_missing_next_steps")} AS missing_next_steps_count, {S("amount", "alert_severity IN ('CRITICAL','HIGH')")} AS at_risk_revenue
 FROM pipeline_hygiene_alerts GROUP BY 1,2)
""")

oracle("hygiene_alert_feed", f"""
SELECT opportunity_id || '_' || primary_alert || '_' || strftime(evaluated_date, '%Y%m%d') AS alert_id, primary_alert AS alert_type, alert_severity, recommended_action,
 opportunity_id, opportunity_name, account_name, amount, stage_name, close_date, health_score, hygiene_score, owner_id, owner_name, days_since_activity, days_until_close,
 days_in_current_stage, stakeholder_count, discount_percent, evaluated_date,
 ':' || {M("alert_severity", {"CRITICAL": "rotating_light:", "HIGH": "warning:", "MEDIUM": "large_yellow_circle:"}, "white_circle:")} || ' *' || alert_severity || '* - ' || account_name
  || ' ($' || format('{{:,}}', round_even(amount,0)::BIGINT) || ') - ' || recommended_action AS slack_message_preview,
 {M("alert_severity", {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3}, 4)} AS priority_rank
FROM pipeline_hygiene_alerts WHERE alert_severity <> 'NONE'
""")

oracle("hygiene_snapshots", f"""
SELECT date_trunc('week', close_date)::DATE AS snapshot_date, round(avg(hygiene_score),1) AS avg_hygiene_score, {N("alert_severity<>'NONE'")} AS total_alerts,
 {N("alert_severity='CRITICAL'")} AS critical_count, {N("is_gone_dark")} AS gone_dark_count, {N("is_single_threaded")} AS single_threaded_count,
 {N("is_stale_close_date")} AS stale_close_count, {S("amount", "alert_severity='CRITICAL'")} AS revenue_at_risk
FROM pipeline_hygiene_alerts GROUP BY 1
""")
oracle("pipeline_hygiene_trends", """
SELECT *, round(avg_hygiene_score - lag(avg_hygiene_score) OVER (ORDER BY snapshot_date),1) AS score_change_wow,
 total_alerts - lag(total_alerts) OVER (ORDER BY snapshot_date) AS alerts_change_wow, weekofyear(snapshot_date)::INT AS week_number,
 'Q' || quarter(snapshot_date) || ' ' || year(snapshot_date) AS quarter
FROM hygiene_snapshots
""")

ORDER = M("stage_name", {"Prospecting": 1, "Discovery": 2, "Solution Design": 3, "Proposal": 4, "Negotiation": 5, "Verbal Commit": 6}, 0)
oracle("stage_velocity", f"""
SELECT *, {ORDER} AS stage_order, CASE WHEN deviation > 20 THEN 'slowing' WHEN deviation < -10 THEN 'accelerating' ELSE 'on_track' END AS trend_direction,
 {M("stage_name", {"Prospecting": 0.65, "Discovery": 0.7, "Solution Design": 0.75, "Proposal": 0.6, "Negotiation": 0.8, "Verbal Commit": 0.95}, 0.5)} AS conversion_rate,
 {QUARTER_AS_OF} AS quarter, 'All' AS region
FROM (SELECT m.*, b.expected_days AS benchmark, round((avg_duration - b.expected_days)/b.expected_days*100,1) AS deviation
 FROM (SELECT stage_name, count(*) AS deals_in_stage, {S("amount")} AS amount_in_stage, round(avg(days_in_current_stage),1) AS avg_duration FROM opportunities WHERE NOT is_closed GROUP BY 1) m
 LEFT JOIN stage_benchmarks b USING (stage_name))
""")

oracle("pipeline_funnel", f"""
SELECT stage_name AS name, {S("amount")} AS amount, count(*) AS count,
 round({S("amount")} / (SELECT {S("amount")} FROM opportunities WHERE {OPEN}), 3) AS conversion_rate, {ORDER} AS stage_order, {QUARTER_AS_OF} AS quarter, 'All' AS region
FROM opportunities WHERE {OPEN} GROUP BY stage_name
""")

from quotaloom import dims  # noqa: E402  (fixed texts only)

oracle("process_bottlenecks", f"""
SELECT *, {L("delay_ratio", ">=", [(2.5, "CRITICAL"), (2.0, "HIGH"), (1.5, "MEDIUM"), (1.2, "LOW")], "ON TARGET")} AS severity,
 round(bottleneck_revenue*days_lost_per_deal*0.01,0) AS estimated_revenue_impact,
 {M("activity", dims.BOTTLENECK_CAUSE, "Process variance - investigate specific cases")} AS root_cause_hypothesis,
 {M("activity", dims.BOTTLENECK_ACTION, "Review individual cases for patterns")} AS recommended_action,
 round(bottleneck_rate*0.4 + delay_ratio*20 + log10(bottleneck_revenue+1)*5, 0) AS priority_score
FROM (SELECT *, round(avg_duration/benchmark_days,2) AS delay_ratio, round(bottleneck_count*100.0/total_occurrences,1) AS bottleneck_rate, greatest(avg_deviation,0.0) AS days_lost_per_deal
FROM (SELECT activity, count(*) AS total_occurrences, round(avg(duration_days),1) AS avg_duration, round({SD("duration_days", 4)},1) AS stddev_duration,
 min(duration_days) AS min_duration, max(duration_days) AS max_duration, max(benchmark_days) AS benchmark_days, round(avg(deviation_days),1) AS avg_deviation,
 {N("is_bottleneck")} AS bottleneck_count, {N("is_rework")} AS rework_count, {S("amount", "is_bottleneck")} AS bottleneck_revenue
 FROM process_events WHERE activity NOT IN ('Lead Created','Closed Won','Closed Lost') GROUP BY 1))
""")

oracle("deals_stuck_in_process", """
SELECT *, CASE WHEN days_until_close < 30 AND deviation_days > 7 THEN 'CRITICAL' WHEN deviation_days > 10 THEN 'HIGH' WHEN deviation_days > 5 THEN 'MEDIUM' ELSE 'LOW' END AS urgency,
 CASE WHEN days_until_close < deviation_days*2 THEN 'HIGH - Likely to slip quarter' WHEN days_until_close < deviation_days*3 THEN 'MEDIUM - At risk of slipping' ELSE 'LOW - Buffer exists' END AS risk_of_slip
FROM (SELECT o.opportunity_id, account_name, opportunity_name, o.amount, owner_name, stage_name, e.activity AS stuck_activity, duration_days, benchmark_days, deviation_days, is_bottleneck,
 health_score_override AS health_score, close_date, (close_date - $AS_OF)::INT AS days_until_close
 FROM opportunities o JOIN (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY timestamp DESC, event_id DESC) AS rn FROM process_events) e ON e.case_id=o.opportunity_id AND rn=1
 WHERE NOT is_closed AND (is_bottleneck OR deviation_days > 5))
""")

oracle("rework_analysis", f"""
SELECT *, round(rework_count/unique_deals,1) AS avg_rework_per_deal, {M("activity", dims.REWORK_CAUSE, "Process variance - review individual cases")} AS rework_cause_hypothesis
FROM (SELECT resource, activity, count(*) AS rework_count, {S("amount")} AS total_amount_affected, count(DISTINCT case_id) AS unique_deals FROM process_events WHERE is_rework GROUP BY 1,2)
""")

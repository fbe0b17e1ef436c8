from oracles import A, L, M, N, R, RD, S, oracle

TEAM = f"(SELECT round({A('win_rate')},3) AS t_win, round({A('avg_stakeholders', None, 1)},1) AS t_st, round(avg(avg_sales_cycle_days),0) AS t_cycle, round({A('avg_deal_size')},0) AS t_size, count(*) AS t_reps FROM sales_reps)"
CLOSED = "stage_name IN ('Closed Won','Closed Lost')"

oracle("rep_performance", f"""
SELECT rep_id, rep_name, email, manager_name, region, segment, role, tenure_months, ytd_attainment, win_rate, avg_stakeholders, avg_sales_cycle_days, current_pipeline, pipeline_coverage, deals_in_pipeline,
 activities_this_month, {RD('won_deals/total_closed', 2)} AS calculated_win_rate, avg_stakeholders_won, avg_stakeholders_lost, won_deals, lost_deals, won_revenue,
 rank() OVER (ORDER BY win_rate DESC) AS overall_rank, rank() OVER (PARTITION BY segment ORDER BY win_rate DESC) AS segment_rank, t_win AS team_avg_win_rate, t_st AS team_avg_stakeholders,
 round(win_rate-t_win,3) AS win_rate_vs_team, round(avg_stakeholders-t_st,1) AS stakeholders_vs_team, round(avg_sales_cycle_days-t_cycle,0) AS cycle_vs_team,
 {L("ytd_attainment", ">=", [(1.1, "Top Performer"), (0.9, "On Track"), (0.7, "Needs Improvement")], "At Risk")} AS performance_tier,
 CASE WHEN avg_stakeholders<2 THEN 'Multi-threading - Avg stakeholders below 2.0' WHEN win_rate<0.20 THEN 'Qualification - Win rate below 20%' WHEN avg_sales_cycle_days>t_cycle*1.3 THEN 'Deal velocity - Cycles 30%+ longer than team'
  WHEN current_pipeline<quarterly_quota*2 THEN 'Pipeline building - Below 2x coverage' ELSE 'No critical gaps' END AS primary_coaching_need,
 CASE WHEN avg_stakeholders<2 THEN 'Shadow top performer (stakeholder avg: 4.2) to learn multi-threading' WHEN win_rate<0.20 THEN 'Review qualification criteria; inspect recent losses' WHEN avg_sales_cycle_days>t_cycle*1.3 THEN 'Analyze stuck deals; identify common stall points'
  WHEN current_pipeline<quarterly_quota*2 THEN 'Focus on prospecting; increase outbound activity' ELSE 'Continue current approach' END AS recommended_action
FROM sales_reps LEFT JOIN (SELECT owner_id AS rep_id, count(*) AS total_closed, {N("is_won")} AS won_deals, {N("NOT is_won")} AS lost_deals, {S("amount", "is_won")} AS won_revenue,
 round(avg(stakeholder_count) FILTER (WHERE is_won),1) AS avg_stakeholders_won, round(avg(stakeholder_count) FILTER (WHERE NOT is_won),1) AS avg_stakeholders_lost FROM opportunities WHERE is_closed GROUP BY 1) m USING (rep_id), {TEAM}
""")

PAT = f"count(*) AS count, round({A('win_rate')},3) AS avg_win_rate, round({A('avg_stakeholders', None, 1)},2) AS avg_stakeholders, round(avg(avg_sales_cycle_days),0) AS avg_cycle_days, round(avg(activities_this_month),0) AS avg_activities, round({A('current_pipeline')},0) AS avg_pipeline FROM sales_reps"
oracle("top_performer_patterns", f"""
SELECT 'Top Performers (100%+ attainment)' AS "group", {PAT.replace(" FROM", ", 'Multi-threading drives wins: 4.0+ stakeholders correlates with higher win rates' AS key_insight FROM")} WHERE ytd_attainment>=1
UNION ALL SELECT 'Team Average', {PAT.replace(" FROM", ", 'Benchmark for comparison' FROM")}
UNION ALL SELECT 'Struggling (<70% attainment)', {PAT.replace(" FROM", ", 'Single-threaded approach failing: <2 stakeholders leads to champion dependency' FROM")} WHERE ytd_attainment<0.7
""")

oracle("coaching_rep_performance", f"""
SELECT rep_id, rep_name, manager_name, region, segment, ytd_attainment, win_rate, coalesce(w,0) AS avg_deal_size, avg_sales_cycle_days AS avg_sales_cycle, (rank() OVER (ORDER BY ytd_attainment DESC))::BIGINT AS overall_rank,
 t_reps AS total_reps, 0 AS rank_change, t_win AS team_avg_win_rate, t_size AS team_avg_deal_size, t_cycle AS team_avg_cycle,
 {L("ytd_attainment", ">=", [(1.1, "Top Performer"), (0.9, "On Track"), (0.7, "Needs Coaching")], "At Risk")} AS performance_tier
FROM sales_reps LEFT JOIN (SELECT owner_id AS rep_id, round({A("amount")},0) AS w FROM opportunities WHERE is_won GROUP BY 1) USING (rep_id), {TEAM}
""")

DRV = [("Win Rate", "win_rate", 3, 0.15), ("Avg Stakeholders", "avg_stakeholders", 1, 0.10), ("Sales Cycle (days)", "avg_sales_cycle_days", 0, -0.08), ("Pipeline Coverage", "pipeline_coverage", 1, 0.12), ("Monthly Activities", "activities_this_month", 0, 0.05)]
oracle("driver_comparisons", " UNION ALL ".join(f"""
SELECT rep_id, '{n}' AS metric_name, {c}::DOUBLE AS rep_value, (SELECT round({A(c)},{d}) FROM sales_reps) AS team_avg, (SELECT round({A(c)},{d}) FROM sales_reps WHERE ytd_attainment>=1) AS top_performer,
 {i}::DOUBLE AS impact_on_quota, percent_rank() OVER (ORDER BY {c}) AS percentile, 'stable' AS trend_direction FROM sales_reps""" for n, c, d, i in DRV))

oracle("activity_metrics", f"""
WITH r AS (SELECT owner_id AS rep_id, count(*) AS total_activities, {N("activity_type='Call'")} AS calls, {N("activity_type='Email'")} AS emails, {N("activity_type='Meeting'")} AS meetings, {N("activity_type='Demo'")} AS demos,
 round(count(*)/20,1) AS avg_daily FROM activities GROUP BY 1)
SELECT *, (SELECT round({A("avg_daily", None, 1)},1) FROM r) AS team_avg_daily, (SELECT round({A("avg_daily", None, 1)},1) FROM (SELECT avg_daily FROM r ORDER BY avg_daily DESC LIMIT 3)) AS top_performer_daily, '[]' AS daily_trend FROM r
""")

oracle("coaching_next_best_actions", f"""
SELECT owner_id AS rep_id, opportunity_id, account_name, action_type,
 CASE action_type WHEN 'Re-engage' THEN 'No activity in ' || days_since_activity || ' days - schedule touchpoint' WHEN 'Multi-thread' THEN 'Only 1-2 stakeholders engaged - identify and engage additional contacts'
  WHEN 'Accelerate' THEN 'Stuck in ' || stage_name || ' for ' || days_in_current_stage || ' days - identify blocker' WHEN 'Rescue' THEN 'Deal health critical - executive intervention may be needed'
  WHEN 'Close' THEN 'In negotiation - push for verbal commit this week' ELSE 'Continue current approach' END AS action_description, priority,
 CASE action_type WHEN 'Rescue' THEN 'Prevent $' || printf('%.2f', amount) || ' loss' WHEN 'Close' THEN 'Win $' || printf('%.2f', amount) || ' this quarter' ELSE 'Improve deal health' END AS expected_impact,
 $AS_OF + CASE WHEN priority=3 THEN 2 ELSE 5 END AS due_date
FROM (SELECT *, CASE WHEN action_type IN ('Rescue','Re-engage') THEN 3 WHEN action_type IN ('Multi-thread','Accelerate') THEN 2 ELSE 1 END AS priority
FROM (SELECT *, CASE WHEN days_since_activity>7 THEN 'Re-engage' WHEN stakeholder_count<2 THEN 'Multi-thread' WHEN days_in_current_stage>14 THEN 'Accelerate' WHEN health_category='Critical' THEN 'Rescue'
 WHEN stage_name='Negotiation' THEN 'Close' ELSE 'Progress' END AS action_type FROM deal_health WHERE NOT is_closed))
""")

oracle("coaching_insights", """
SELECT rep_id, 'strength' AS insight_type, 'Strong Closer' AS title, 'Win rate of ' || round(win_rate*100,0)::INT || '% exceeds team average' AS description, '+5% quota impact' AS metric_impact,
 'Continue current approach' AS recommended_action, 1 AS priority, 'Performance' AS category FROM sales_reps WHERE win_rate>=0.30
UNION ALL SELECT rep_id, 'improvement', 'Multi-threading Opportunity', 'Average of ' || printf('%.1f', avg_stakeholders) || ' stakeholders per deal below top performer benchmark of 4.0', '+12% win rate potential',
 'Shadow top performer; focus on executive engagement', 2, 'Deal Strategy' FROM sales_reps WHERE avg_stakeholders<2.5
UNION ALL SELECT rep_id, 'action', 'Pipeline Building Required', 'Pipeline coverage of ' || printf('%.1f', pipeline_coverage) || 'x below target of 3x', '-15% quota risk', 'Increase prospecting activity by 20%', 3, 'Pipeline'
 FROM sales_reps WHERE pipeline_coverage<2.5
""")
oracle("rep_roster", "SELECT rep_id, rep_name, region, segment, manager_name, role FROM sales_reps")

oracle("compensation_summary", f"""
SELECT {S("quarterly_quota")} AS total_quota, {S("won")} AS total_closed, round({S("won")}/{S("quarterly_quota")},3) AS team_attainment, round({A("ytd_attainment")},3) AS avg_rep_attainment,
 {N("ytd_attainment>=1")} AS on_track_count, {N("ytd_attainment>=0.8 AND ytd_attainment<1")} AS at_risk_count, {N("ytd_attainment>=1.1")} AS overachievers_count, {S("com")} AS total_commission_paid,
 round({S("com")}*1.15,0) AS projected_commission, {N("ytd_attainment>=1")} AS accelerator_eligible, $AS_OF AS snapshot_date
FROM (SELECT *, coalesce(w,0) AS won, round(coalesce(w,0)*CASE WHEN ytd_attainment>=1.2 THEN 0.15 WHEN ytd_attainment>=1 THEN 0.12 ELSE 0.10 END,0) AS com
 FROM sales_reps LEFT JOIN (SELECT owner_id AS rep_id, {S("amount")} AS w FROM opportunities WHERE is_won GROUP BY 1) USING (rep_id))
""")

oracle("rep_attainment", f"""
SELECT rep_id, rep_name, region, segment, quarterly_quota AS quota, closed_won, attainment, round(closed_won*rate,0) AS commission_earned, round((closed_won+"commit"*0.8)*rate,0) AS projected_commission,
 {L("attainment", ">=", [(1.3, "President's Club"), (1.2, "Platinum"), (1.0, "Gold")], "Standard")} AS accelerator_tier, {L("attainment", ">=", [(1.3, 2.0), (1.2, 1.5), (1.0, 1.2)], 1.0)} AS accelerator_multiplier,
 greatest(0.0, quarterly_quota-closed_won) AS gap_to_accelerator, {L("attainment", ">=", [(1.0, "Achieved"), (0.8, "On Track")], "At Risk")} AS status, pipeline, "commit",
 round((closed_won+"commit"*0.7)/quarterly_quota,3) AS projected_attainment
FROM (SELECT *, CASE WHEN attainment>=1.2 THEN 0.15 WHEN attainment>=1 THEN 0.12 ELSE 0.10 END AS rate FROM (SELECT r.*, coalesce(w,0) AS closed_won, coalesce(p,0) AS pipeline, coalesce(cm,0) AS "commit",
 round(coalesce(w,0)/quarterly_quota,3) AS attainment FROM sales_reps r LEFT JOIN (SELECT owner_id AS rep_id, {S("amount", "is_won")} AS w, {S("amount", "NOT is_closed")} AS p,
 {S("amount", "NOT is_closed AND forecast_category='Commit'")} AS cm FROM opportunities GROUP BY 1) m USING (rep_id)))
""")

oracle("attainment_trend", f"""
WITH g AS (SELECT rep_id, quarterly_quota, w::INT AS week_number FROM sales_reps, range(1, ((DATE '2001-12-31' - DATE '2001-10-01')//7 + 2)) t(w)),
c AS (SELECT g.*, {S("amount")} AS won FROM g LEFT JOIN opportunities o ON o.owner_id=rep_id AND is_won AND close_date BETWEEN DATE '2001-10-01' AND $AS_OF
  AND (close_date - DATE '2001-10-01')//7 + 1 <= week_number GROUP BY ALL)
SELECT week_number, round({S("won")}/{S("quarterly_quota")},3) AS team_attainment, round({A("won/quarterly_quota", None, 6)},3) AS avg_rep_attainment, round({N("won/quarterly_quota>=0.9")}/count(*),3) AS on_track_pct,
 round({N("won/quarterly_quota<0.7")}/count(*),3) AS at_risk_pct, round({N("won/quarterly_quota>=1.1")}/count(*),3) AS overachiever_pct,
 least(DATE '2001-10-01' + (week_number*7-1)::INT, $AS_OF) AS snapshot_date, round(week_number/13,3) AS quota_pace FROM c GROUP BY week_number
""")

PEND = "(days_in_current_stage>10 OR coalesce(discount_percent,0)>25)"
oracle("dealdesk_summary", f"""
SELECT {N(PEND)} AS pending_approvals, {S("amount", PEND)} AS pending_value, round(avg(days_in_current_stage) FILTER (WHERE {PEND}),1) AS avg_approval_time, {N("days_in_current_stage>5")} AS sla_breach_count,
 {N(f"NOT {PEND} AND days_in_current_stage<=1")} AS approved_today, 0 AS rejected_today, round({A("discount_percent", None, 1)},1) AS avg_discount, 'stable' AS discount_trend,
 '{{"high":' || {N("amount>500000 OR days_in_current_stage>14")} || ',"medium":' || {N("amount<=500000 AND days_in_current_stage<=14 AND amount>200000")} || ',"low":' || {N("amount<=200000 AND days_in_current_stage<=14")} || '}}' AS deals_by_urgency,
 $AS_OF AS snapshot_date FROM opportunities WHERE stage_name='Negotiation' OR coalesce(discount_percent,0)>15
""")

oracle("deal_approvals", """
SELECT opportunity_id AS deal_id, opportunity_name, account_name, owner_name AS rep_name, amount AS deal_value, discount_percent/100 AS discount_pct, round(amount*discount_percent/100,0) AS discount_amount,
 CASE WHEN days_in_current_stage>10 THEN 'Pending Review' WHEN discount_percent>25 THEN 'Escalated' ELSE 'Auto-Approved' END AS approval_status, $AS_OF - days_in_current_stage AS submitted_at,
 CASE WHEN amount>500000 THEN 'Critical' WHEN days_in_current_stage>14 THEN 'High' WHEN amount>200000 THEN 'Medium' ELSE 'Low' END AS urgency,
 CASE WHEN amount>500000 THEN 'VP Sales' WHEN discount_percent>25 THEN 'Deal Desk Manager' ELSE 'Sales Manager' END AS approver_name, CASE WHEN amount>500000 THEN 3 WHEN discount_percent>25 THEN 2 ELSE 1 END AS approval_level,
 days_in_current_stage AS time_in_queue, CASE WHEN days_in_current_stage>5 THEN 'Breached' WHEN days_in_current_stage>3 THEN 'At Risk' ELSE 'On Track' END AS sla_status,
 CASE WHEN competitor_mentioned IS NOT NULL THEN 'Competitive pressure' WHEN amount>300000 THEN 'Volume discount' ELSE 'Standard negotiation' END AS discount_reason, competitor_mentioned AS competitor, close_date
FROM opportunities WHERE (stage_name='Negotiation' OR discount_percent>10) AND NOT is_closed
""")

oracle("discount_analysis", f"""
SELECT segment, count(*) AS deal_count, {S("amount")} AS total_value, round({A("discount_percent", None, 1)},1) AS avg_discount, round(median(discount_percent),1) AS median_discount, max(discount_percent) AS max_discount,
 {N("discount_percent>=0 AND discount_percent<10")} AS discount_0_10, {N("discount_percent>=10 AND discount_percent<20")} AS discount_10_20, {N("discount_percent>=20")} AS discount_20_plus,
 round({N("is_won AND discount_percent>5")}/{N("discount_percent>5")},3) AS win_rate_with_discount, round({N("is_won AND discount_percent<=5")}/{N("discount_percent<=5")},3) AS win_rate_without_discount,
 round(avg(days_to_close) FILTER (WHERE discount_percent>5),0) AS avg_cycle_with_discount, round(avg(days_to_close) FILTER (WHERE discount_percent<=5),0) AS avg_cycle_without_discount, 'stable' AS trend
FROM opportunities WHERE is_closed GROUP BY 1
""")

WL = f"""{N("is_won")} AS wins, {N("NOT is_won")} AS losses, {S("amount", "is_won")} AS won_revenue, {S("amount", "NOT is_won")} AS lost_revenue,
 avg(days_to_close) FILTER (WHERE is_won) AS avg_won_cycle, avg(days_to_close) FILTER (WHERE NOT is_won) AS avg_lost_cycle"""
oracle("win_loss_summary", f"""
SELECT *, round(total_won::DOUBLE/total_closed*100,1) AS win_rate, round(total_lost::DOUBLE/total_closed*100,1) AS loss_rate, round(won_revenue/(won_revenue+lost_revenue)*100,1) AS win_rate_by_value,
 avg_won_deal_size-avg_lost_deal_size AS deal_size_gap, avg_lost_cycle-avg_won_cycle AS cycle_gap
FROM (SELECT count(*) AS total_closed, {WL.replace("AS wins", "AS total_won").replace("AS losses", "AS total_lost")}, {A("amount", "is_won")} AS avg_won_deal_size, {A("amount", "NOT is_won")} AS avg_lost_deal_size FROM deal_health WHERE is_closed)
""")
oracle("loss_reasons", f"""
WITH l AS (SELECT * FROM deal_health WHERE is_closed AND NOT is_won)
SELECT *, {L("revenue_share_pct", ">=", [(30, "Critical"), (15, "High"), (5, "Medium")], "Low")} AS threat_level
FROM (SELECT competitor_mentioned AS primary_competitor, count(*) AS deals_lost, {S("amount")} AS revenue_lost, {A("amount")} AS avg_deal_size, avg(health_score) AS avg_health_at_loss, avg(days_to_close) AS avg_cycle_days,
 round(count(*)/(SELECT count(*) FROM l)*100,1) AS loss_share_pct, round({S("amount")}/(SELECT {S("amount")} FROM l)*100,1) AS revenue_share_pct FROM l WHERE competitor_mentioned IS NOT NULL GROUP BY 1)
""")
_f = lambda name, w, good, bad, y, n: f"SELECT '{name}' AS factor, {w('is_won')} AS won_avg, {w('NOT is_won')} AS lost_avg, {w('is_won')} - {w('NOT is_won')} AS difference, CASE WHEN {w('is_won')} > {w('NOT is_won')} THEN '{good}' ELSE '{bad}' END AS impact, CASE WHEN {w('is_won')} > {w('NOT is_won')} THEN '{y}' ELSE '{n}' END AS recommendation FROM c"
_avg = lambda x: lambda p: f"(avg({x}) FILTER (WHERE {p}))"
oracle("win_factors", f"""
WITH c AS (SELECT d.*, coalesce(n,0) AS activity_count FROM deal_health d LEFT JOIN (SELECT opportunity_id, count(*) AS n FROM activities GROUP BY 1) USING (opportunity_id) WHERE is_closed)
{_f("Stakeholder Count", _avg("stakeholder_count"), "positive", "negative", "Increase multi-threading on deals", "Review stakeholder strategy")}
UNION ALL {_f("Activity Volume", _avg("activity_count"), "positive", "negative", "Maintain high activity levels", "Increase engagement frequency")}
UNION ALL {_f("Health Score", _avg("health_score"), "positive", "positive", "Health score is predictive - monitor closely", "Health score is predictive - monitor closely")}
UNION ALL {_f("Discount Level", lambda p: A("discount_percent", p, 1), "negative", "neutral", "Higher discounts correlate with wins but impact margin", "Discounting not primary factor")}
UNION ALL {_f("Deal Size", lambda p: A("amount", p), "neutral", "neutral", "Larger deals have different dynamics - adjust strategy by size", "Larger deals have different dynamics - adjust strategy by size")}
""")
oracle("competitive_battles", f"""
SELECT *, CASE WHEN win_rate>=60 THEN 'Strong' WHEN win_rate>=40 THEN 'Competitive' ELSE 'Weak' END AS competitive_position, CASE WHEN total_battles>=5 AND win_rate<50 THEN 'High' WHEN total_battles>=3 THEN 'Medium' ELSE 'Low' END AS priority
FROM (SELECT competitor_mentioned AS primary_competitor, count(*) AS total_battles, {N("is_won")} AS wins, {N("NOT is_won")} AS losses, {S("amount", "is_won")} AS revenue_won, {S("amount", "NOT is_won")} AS revenue_lost,
 {A("amount")} AS avg_battle_size, round({N("is_won")}/count(*)*100,1) AS win_rate, round({N("NOT is_won")}/count(*)*100,1) AS loss_rate, round({S("amount", "is_won")} - {S("amount", "NOT is_won")},2) AS net_revenue
 FROM deal_health WHERE is_closed AND competitor_mentioned IS NOT NULL GROUP BY 1)
""")
oracle("win_loss_by_segment", f"""
SELECT *, CASE WHEN win_rate>=40 THEN 'Strong' WHEN win_rate>=25 THEN 'Average' ELSE 'Needs Improvement' END AS performance_tier FROM (
SELECT *, round(wins/total_deals*100,1) AS win_rate, round(won_revenue/(won_revenue+lost_revenue)*100,1) AS revenue_win_rate FROM (
SELECT 'segment' AS dimension, segment AS dimension_value, count(*) AS total_deals, {WL} FROM deal_health WHERE is_closed GROUP BY 2
UNION ALL SELECT 'size_band', {L("amount", ">=", [(500000, "Enterprise ($500K+)"), (100000, "Mid-Market ($100K-$500K)"), (25000, "SMB ($25K-$100K)")], "Velocity (<$25K)")}, count(*), {WL} FROM deal_health WHERE is_closed GROUP BY 2))
""")

from oracles import A, L, M, N, QUARTER_AS_OF, R, S, oracle

Q_START, Q_END = "DATE '2001-10-01'", "DATE '2001-12-31'"
IN_Q = f"close_date BETWEEN {Q_START} AND {Q_END}"
RATES = {"Commit": (0.95, 0.75, 0.50), "Best Case": (0.50, 0.40, 0.25), "Pipeline": (0.30, 0.20, 0.10)}


def _line(cat, extra):
    hi, mid, lo = RATES[cat]
    w = f"amount * CASE WHEN health_score>=80 THEN {hi} WHEN health_score>=60 THEN {mid} ELSE {lo} END"
    cond = f"forecast_category='{cat}' AND stage_name <> 'Closed Lost'{extra}"
    return f"SELECT '{cat}' AS category, {S('amount', cond)} AS amount, {S(w, cond, 4)} AS weighted_amount FROM q"


oracle("forecast_confidence", f"""
WITH q AS (SELECT * FROM deal_health WHERE {IN_Q}),
c AS (SELECT 'Closed Won' AS category, {S("amount", "stage_name='Closed Won'")} AS amount, {S("amount", "stage_name='Closed Won'")} AS weighted_amount FROM q
 UNION ALL {_line("Commit", " AND stage_name <> 'Closed Won'")} UNION ALL {_line("Best Case", "")} UNION ALL {_line("Pipeline", "")}),
r AS (SELECT category, amount, CASE WHEN category='Closed Won' THEN 100.0 ELSE round({R("weighted_amount", "amount", None, 2, 0)}*100,0) END AS confidence_pct, weighted_amount FROM c
 UNION ALL SELECT 'TOTAL FORECAST', round(sum(amount),2), {R("sum(weighted_amount)", "sum(amount)", 100, 0, 0)}, round(sum(weighted_amount),4) FROM c),
t AS (SELECT *, 13000000.0 AS quarter_target, CASE WHEN category='TOTAL FORECAST' THEN round(weighted_amount/13000000*100,1) END AS pct_of_target,
 CASE WHEN category='TOTAL FORECAST' THEN 13000000.0 - weighted_amount END AS gap_to_target FROM r)
SELECT *, CASE WHEN pct_of_target>=100 THEN 'ON TRACK' WHEN pct_of_target>=95 THEN 'ACHIEVABLE' WHEN pct_of_target>=85 THEN 'AT RISK' WHEN pct_of_target IS NOT NULL THEN 'CRITICAL' END AS risk_assessment FROM t
""")

oracle("swing_deals", f"""
SELECT opportunity_id, account_name, opportunity_name, amount, owner_name, stage_name, forecast_category, health_score,
 CASE WHEN forecast_category='Commit' THEN CASE WHEN health_score<60 THEN 'MUST WIN - At Risk' WHEN health_score<80 THEN 'MUST WIN - Monitor' ELSE 'MUST WIN - Healthy' END
  WHEN forecast_category='Best Case' AND health_score>=70 THEN 'UPSIDE - Good Chance' ELSE 'UPSIDE - Needs Work' END AS swing_category,
 p AS win_probability, round(amount*p,0) AS expected_value, days_in_current_stage, stakeholder_count, has_champion
FROM (SELECT *, {L("health_score", ">=", [(80, 0.85), (70, 0.7), (60, 0.55), (50, 0.4)], 0.25)} AS p FROM deal_health)
WHERE {IN_Q} AND NOT is_closed AND (amount>=300000 OR (forecast_category='Commit' AND health_score<70) OR is_hero_deal)
""")

ADJ = "amount * CASE health_category WHEN 'Healthy' THEN 1.0 WHEN 'Monitor' THEN 0.85 WHEN 'At Risk' THEN 0.60 WHEN 'Critical' THEN 0.30 ELSE CASE WHEN stage_name='Closed Won' THEN 1.0 ELSE 0.5 END END"
ROLL = f"""{S("amount", "stage_name='Closed Won'")} AS closed_won, {S("amount", "forecast_category='Commit'")} AS commit_raw, {S("amount", "forecast_category='Best Case'")} AS best_case_raw,
 {S("amount", "forecast_category='Pipeline'")} AS pipeline_raw, {S(ADJ, "forecast_category='Commit'", 4)} AS commit_adjusted, {S(ADJ, "forecast_category='Best Case'", 4)} AS best_case_adjusted,
 {N("forecast_category='Commit'")} AS commit_count, {N("forecast_category='Best Case'")} AS best_case_count, {N("stage_name='Closed Won'")} AS closed_won_count, count(*) AS total_deals,
 count(DISTINCT owner_id) AS rep_count, avg(health_score) FILTER (WHERE stage_name<>'Closed Won') AS avg_open_deal_health,
 {S("amount", "forecast_category IN ('Commit','Best Case') AND health_category IN ('At Risk','Critical')")} AS at_risk_in_forecast"""
oracle("forecast_rollup", f"""
SELECT *, {R("adjusted_forecast", "total_forecast", empty=1)} AS forecast_confidence FROM (
SELECT *, closed_won+commit_raw+best_case_raw AS total_forecast, closed_won+commit_adjusted+best_case_adjusted*0.5 AS adjusted_forecast FROM (
SELECT NULL::VARCHAR AS region, NULL::BIGINT AS manager_id, NULL::VARCHAR AS manager_name, 'company' AS level, {ROLL} FROM opportunity_health_scored WHERE {IN_Q}
UNION ALL SELECT region, NULL, NULL, 'region', {ROLL} FROM opportunity_health_scored WHERE {IN_Q} GROUP BY region
UNION ALL SELECT region, manager_id, manager_name, 'manager', {ROLL} FROM opportunity_health_scored WHERE {IN_Q} GROUP BY 1,2,3))
""")
oracle("company_forecast", f"""
SELECT closed_won, commit_raw, best_case_raw, pipeline_raw, commit_adjusted, best_case_adjusted, commit_count, best_case_count, closed_won_count, avg_open_deal_health, at_risk_in_forecast,
 total_forecast, adjusted_forecast, forecast_confidence, {R("closed_won", "total_forecast", empty=0)} AS closed_pct, commit_raw+best_case_raw AS remaining_to_close, {QUARTER_AS_OF} AS quarter
FROM forecast_rollup WHERE level='company'
""")
oracle("region_forecast", "SELECT region, closed_won, commit_raw, best_case_raw, commit_adjusted, best_case_adjusted, commit_count, avg_open_deal_health, total_forecast, adjusted_forecast, forecast_confidence FROM forecast_rollup WHERE level='region'")
oracle("manager_forecast", "SELECT manager_id, manager_name, region, closed_won, commit_raw, best_case_raw, commit_adjusted, total_deals, rep_count, avg_open_deal_health AS avg_team_health, total_forecast FROM forecast_rollup WHERE level='manager'")

HW = "amount*(win_probability/100)*(health_score/100)"
oracle("forecast_methods", f"""
SELECT *, round(bottom_up_commit/quota,2) AS bottom_up_coverage, round(ai_weighted_forecast/quota,2) AS ai_coverage, round(total_pipeline/quota,2) AS pipeline_coverage,
 round(bottom_up_best_case-ai_weighted_forecast,6) AS forecast_spread, round((bottom_up_commit-ai_weighted_forecast)/ai_weighted_forecast*100,1) AS methodology_variance_pct, $AS_OF AS snapshot_date
FROM (SELECT {S("amount", "forecast_category='Commit'")} AS bottom_up_commit, {S("amount", "forecast_category IN ('Commit','Best Case')")} AS bottom_up_best_case, {S("amount")} AS total_pipeline,
 {S(HW, None, 6)} AS ai_weighted_forecast, {S("amount*(win_probability/100)", None, 4)} AS probability_weighted, {S("amount", "win_probability>=70 AND health_score>=60")} AS high_confidence_amount,
 count(*) AS total_deals, {N("forecast_category='Commit'")} AS commit_deals, avg(win_probability) AS avg_win_probability, avg(health_score) AS avg_health_score,
 (SELECT {S("quota_amount")} FROM quotas) AS quota FROM deal_health WHERE NOT is_closed)
""")

SEG = f"""{S("amount")} AS pipeline_amount, {S("amount", "forecast_category='Commit'")} AS commit_amount, {S(HW, None, 6)} AS weighted_forecast, count(*) AS deal_count, avg(health_score) AS avg_health, avg(win_probability) AS avg_win_prob FROM deal_health WHERE NOT is_closed GROUP BY 2"""
oracle("forecast_by_segment", f"""
SELECT *, round(commit_amount/pipeline_amount*100,1) AS commit_rate, round((avg_health+avg_win_prob)/2,0) AS confidence_score
FROM (SELECT 'segment' AS dimension, segment AS dimension_value, {SEG} UNION ALL SELECT 'rep', owner_name, {SEG} UNION ALL SELECT 'stage', stage_name, {SEG})
""")

POS = "created_date <= d AND NOT (is_closed AND close_date <= d)"
oracle("forecast_history", f"""
SELECT *, round(target-closed_won-ai_forecast,4) AS gap_to_target, round(ai_forecast/target*100,1) AS forecast_accuracy FROM (
SELECT week_number, 'W' || week_number AS week_label, d AS snapshot_date, {S("amount", POS, 4)} AS pipeline_amount, {S("amount", POS + " AND forecast_category='Commit'", 4)} AS commit_amount,
 {S("amount*(win_probability/100)", POS, 4)} AS ai_forecast, {S("amount", "is_won AND close_date <= d", 4)} AS closed_won, 8500000.0 AS target
FROM deal_health, (SELECT i::INT AS week_number, $AS_OF - ((12-i)*7)::INT AS d FROM range(1,13) t(i)) GROUP BY week_number, d)
""")

QS = [("DATE '2001-01-01'", "DATE '2001-03-31'"), ("DATE '2001-04-01'", "DATE '2001-06-30'"), ("DATE '2001-07-01'", "DATE '2001-09-30'")]
_acc = lambda fc: ", ".join(f"greatest(0.0, 1 - abs({fc}{i}-won{i})/{fc}{i}) AS a{i}" for i in range(3)) + ", " + " + ".join(f"({fc}{i}-won{i})" for i in range(3)) + " AS lean"
oracle("forecast_accuracy", f"""
WITH o AS (SELECT {", ".join(f'''{S("amount", f"is_won AND close_date BETWEEN {a} AND {b}")} AS won{i}, {S("amount", f"health_score>=60 AND close_date BETWEEN {a} AND {b}")} AS c{i},
 {S("amount*(health_score/100)", f"close_date BETWEEN {a} AND {b}", 4)} AS w{i}, {S("amount", f"close_date BETWEEN {a} AND {b}")} * ({S("amount", f"is_won AND close_date < {a}")} / {S("amount", f"close_date < {a}")}) AS h{i}''' for i, (a, b) in enumerate(QS))}
 FROM deal_health WHERE is_closed),
r AS (SELECT 'Bottom-Up Commit' AS method, {_acc("c")} FROM o UNION ALL SELECT 'AI-Weighted', {_acc("w")} FROM o UNION ALL SELECT 'Historical Rate', {_acc("h")} FROM o)
SELECT *, CASE WHEN avg_accuracy>=0.9 THEN 'High' WHEN avg_accuracy>=0.8 THEN 'Medium' ELSE 'Low' END AS accuracy_tier, avg_accuracy>=0.9 AS recommended
FROM (SELECT method, round(a0,4) AS q1_accuracy, round(a1,4) AS q2_accuracy, round(a2,4) AS q3_accuracy, round((a0+a1+a2)/3,4) AS avg_accuracy,
 CASE WHEN lean>0 THEN 'optimistic' WHEN lean<0 THEN 'pessimistic' ELSE 'neutral' END AS bias FROM r)
""")

oracle("forecast_summary", """
SELECT quota, total_pipeline, pipeline_coverage, bottom_up_commit AS bottom_up_forecast, ai_weighted_forecast AS ai_forecast, bottom_up_best_case AS best_case_forecast, high_confidence_amount,
 methodology_variance_pct, a.method AS recommended_method, a.avg_accuracy AS method_accuracy, h.gap_to_target, h.closed_won AS closed_won_ytd, coalesce(s.dimension_value,'N/A') AS top_segment,
 coalesce(s.weighted_forecast,0) AS top_segment_forecast, CASE WHEN ai_coverage>=0.9 THEN 'High' WHEN ai_coverage>=0.7 THEN 'Medium' ELSE 'Low' END AS forecast_confidence, 4 AS weeks_remaining,
 (quota-h.closed_won)/4 AS required_weekly_close, forecast_methods.snapshot_date AS snapshot_date
FROM forecast_methods, (SELECT * FROM forecast_accuracy ORDER BY avg_accuracy DESC, method DESC LIMIT 1) a, (SELECT * FROM forecast_history WHERE week_number=12) h,
 (SELECT * FROM forecast_by_segment WHERE dimension='segment' ORDER BY weighted_forecast DESC LIMIT 1) s
""")

oracle("win_probability_scores", f"""
WITH f AS (SELECT d.* EXCLUDE (days_since_activity, win_probability), touches, rep_win_rate, ($AS_OF-last_touch)::INT AS quiet,
 health_score AS health_factor, {L("($AS_OF-last_touch)", "<=", [(3, 100), (7, 80), (14, 50), (21, 30)], 10)} AS activity_recency_factor, least(coalesce(touches,0)*10,100) AS activity_volume_factor,
 {L("stakeholder_count", ">=", [(5, 100), (4, 90), (3, 75), (2, 50)], 20)} AS stakeholder_factor,
 CASE WHEN days_in_current_stage<=coalesce(expected_days,14) THEN 100 WHEN days_in_current_stage<=coalesce(expected_days,14)*1.5 THEN 70 WHEN days_in_current_stage<=coalesce(expected_days,14)*2 THEN 40 ELSE 15 END AS velocity_factor,
 coalesce(rep_win_rate,0.25)*100*2 AS rep_factor, CASE WHEN is_competitive THEN 60 ELSE 100 END AS competitive_factor,
 CASE WHEN coalesce(discount_percent,0)>30 THEN 40 WHEN coalesce(discount_percent,0)>20 THEN 60 WHEN coalesce(discount_percent,0)>10 THEN 80 ELSE 100 END AS discount_factor
 FROM deal_health d LEFT JOIN (SELECT opportunity_id, count(*) AS touches, max(activity_date) AS last_touch FROM activities GROUP BY 1) t USING (opportunity_id)
 LEFT JOIN (SELECT rep_id AS owner_id, win_rate AS rep_win_rate FROM rep_performance) r USING (owner_id) LEFT JOIN stage_benchmarks b USING (stage_name) WHERE NOT is_closed),
p AS (SELECT *, least(health_factor*0.25 + activity_recency_factor*0.20 + activity_volume_factor*0.10 + stakeholder_factor*0.15 + velocity_factor*0.10 + rep_factor*0.10 + competitive_factor*0.05 + discount_factor*0.05,
 {M("stage_name", {"Prospecting": 40.0, "Discovery": 55.0, "Solution Design": 70.0, "Proposal": 85.0, "Negotiation": 95.0, "Verbal Commit": 98.0}, 50.0)}) AS p FROM f)
SELECT opportunity_id, opportunity_name, account_name, owner_id, owner_name, amount, stage_name, close_date, health_score, round(p::DECIMAL(28,8),1)::DOUBLE AS win_probability,
 {L("p", ">=", [(75, "High"), (50, "Medium"), (25, "Low")], "Very Low")} AS win_probability_tier,
 CASE WHEN touches IS NOT NULL AND stakeholder_count IS NOT NULL AND rep_win_rate IS NOT NULL THEN 'High' WHEN touches IS NOT NULL OR stakeholder_count IS NOT NULL THEN 'Medium' ELSE 'Low' END AS prediction_confidence,
 health_factor, activity_recency_factor, stakeholder_factor, velocity_factor, round(rep_factor,1) AS rep_factor, competitive_factor, coalesce(quiet,0) AS days_since_activity,
 coalesce(stakeholder_count,1) AS stakeholder_count, coalesce(touches,0) AS total_activities, round(amount*p/100,0) AS weighted_amount, $AS_OF AS scored_date FROM p
""")

oracle("slip_risk_scores", f"""
WITH f AS (SELECT *, (close_date-$AS_OF)::INT AS days_until_close, {L("(close_date-$AS_OF)", "<", [(0, 95), (7, 70), (14, 50), (30, 30)], 15)} AS time_pressure_factor,
 CASE WHEN close_date-$AS_OF<30 AND stage_name IN ('Prospecting','Discovery','Solution Design') THEN 85 WHEN close_date-$AS_OF<14 AND stage_name='Proposal' THEN 60
  WHEN close_date-$AS_OF<7 AND stage_name<>'Verbal Commit' THEN 75 ELSE 20 END AS stage_alignment_factor,
 {L("days_since_activity", ">", [(14, 80), (7, 50), (3, 25)], 10)} AS momentum_factor, 100-win_probability AS doubt FROM win_probability_scores),
g AS (SELECT *, time_pressure_factor*0.30 + stage_alignment_factor*0.30 + momentum_factor*0.20 + doubt*0.20 AS sc FROM f),
h AS (SELECT *, {L("sc", ">=", [(70, "High"), (45, "Medium")], "Low")} AS slip_risk_tier FROM g)
SELECT opportunity_id, opportunity_name, account_name, owner_id, owner_name, amount, stage_name, close_date, days_until_close, win_probability, round(sc::DECIMAL(28,8),1)::DOUBLE AS slip_risk_score, slip_risk_tier,
 CASE WHEN days_until_close<0 THEN 'Close date already passed' WHEN stage_alignment_factor>=60 THEN 'Still in ' || stage_name || ' with only ' || days_until_close || ' days left'
  WHEN momentum_factor>=50 THEN 'No activity in ' || days_since_activity || ' days' WHEN doubt>=50 THEN 'Low win probability' ELSE 'On track' END AS slip_risk_reason,
 time_pressure_factor, stage_alignment_factor, momentum_factor, CASE slip_risk_tier WHEN 'High' THEN amount WHEN 'Medium' THEN amount*0.5 ELSE 0.0 END AS slip_risk_amount, $AS_OF AS scored_date FROM h
""")

oracle("leading_indicators_summary", f"""
SELECT *, round(probability_weighted_pipeline-total_slip_risk_amount,3) AS ai_forecast_adjustment,
 CASE WHEN avg_win_probability>=60 AND avg_slip_risk<40 THEN 'High' WHEN avg_win_probability>=45 AND avg_slip_risk<55 THEN 'Medium' ELSE 'Low' END AS forecast_confidence,
 CASE WHEN avg_activity_recency<50 THEN 'Activity engagement declining' WHEN avg_stakeholder_engagement<50 THEN 'Insufficient stakeholder coverage' WHEN avg_velocity_score<50 THEN 'Deals progressing slowly'
  WHEN avg_slip_risk>=50 THEN 'High slip risk concentration' ELSE 'No major concerns' END AS primary_risk_factor, $AS_OF AS scored_date
FROM (SELECT count(*) AS total_opportunities, {S("amount")} AS total_pipeline, {S("weighted_amount")} AS probability_weighted_pipeline, round({A("win_probability", None, 1)},1) AS avg_win_probability,
 {", ".join(f'''{N(f"win_probability_tier='{t}'")} AS {t.lower()}_prob_count, {S("amount", f"win_probability_tier='{t}'")} AS {t.lower()}_prob_amount''' for t in ("High", "Medium", "Low"))},
 round(avg(activity_recency_factor),1) AS avg_activity_recency, round(avg(stakeholder_factor),1) AS avg_stakeholder_engagement, round(avg(velocity_factor),1) AS avg_velocity_score FROM win_probability_scores),
 (SELECT {", ".join(f'''{N(f"slip_risk_tier='{t}'")} AS {t.lower()}_slip_risk_count, {S("amount", f"slip_risk_tier='{t}'")} AS {t.lower()}_slip_risk_amount''' for t in ("High", "Medium"))},
 {S("slip_risk_amount", None, 3)} AS total_slip_risk_amount, round({A("slip_risk_score", None, 1)},1) AS avg_slip_risk FROM slip_risk_scores)
""")

oracle("deal_predictions", """
SELECT w.opportunity_id, opportunity_name, account_name, owner_id, owner_name, amount, stage_name, close_date, health_score, win_probability, win_probability_tier, coalesce(r,0) AS slip_risk_score,
 coalesce(slip_risk_tier,'Low') AS slip_risk_tier,
 CASE WHEN win_probability>=70 AND r<40 THEN 'Strong likelihood to close this quarter' WHEN win_probability>=50 AND r<50 THEN 'Good probability with manageable risk'
  WHEN win_probability>=50 AND r>=50 THEN 'Good potential but slip risk is elevated' WHEN win_probability<50 AND r>=60 THEN 'At risk - needs intervention to stay on track' ELSE 'Uncertain - requires close monitoring' END AS prediction_summary,
 CASE WHEN activity_recency_factor<50 THEN 'Re-engage - activity has dropped off' WHEN stakeholder_factor<50 THEN 'Multi-thread - need more stakeholders' WHEN velocity_factor<50 THEN 'Accelerate - deal is stalling'
  WHEN r>=60 THEN 'Close date at risk - validate timeline' ELSE 'Continue current approach' END AS recommended_focus,
 CASE WHEN win_probability>=70 THEN 'WIN' WHEN win_probability>=40 THEN 'TOSS-UP' ELSE 'UNLIKELY' END AS expected_outcome, weighted_amount, coalesce(slip_risk_amount,0) AS slip_risk_amount,
 health_factor, activity_recency_factor, stakeholder_factor, velocity_factor, prediction_confidence, scored_date
FROM win_probability_scores w LEFT JOIN (SELECT opportunity_id, slip_risk_score AS r, slip_risk_tier, slip_risk_amount FROM slip_risk_scores) s USING (opportunity_id)
""")

oracle("scenario_base_metrics", f"""
SELECT *, round(total_pipeline/total_quota,2) AS coverage_ratio, round(weighted_pipeline/total_quota,2) AS weighted_coverage
FROM (SELECT count(*) AS total_deals, {S("amount")} AS total_pipeline, {A("amount")} AS avg_deal_size, avg(health_score) AS avg_health_score, avg(win_probability) AS avg_win_probability,
 {S("amount*win_probability/100", None, 4)} AS weighted_pipeline, (SELECT {S("quota_amount")} FROM quotas) AS total_quota FROM deal_health WHERE NOT is_closed)
""")
oracle("open_totals", f"SELECT count(*) AS n, {S('amount')} AS pool, {A('amount')} AS size, avg(win_probability)/100 AS rate, avg(days_in_current_stage) AS days FROM deal_health WHERE NOT is_closed")
oracle("scenario_win_rate_impact", f"""
SELECT scenario_name, d AS win_rate_delta, nr AS projected_win_rate, pool*nr AS projected_revenue, pool*nr - pool*rate AS revenue_delta, {R("d", "rate", empty=0)} AS revenue_delta_pct
FROM (SELECT *, least(1.0, greatest(0.0, rate+d)) AS nr FROM open_totals, (VALUES ('-10% Win Rate',-0.1),('-5% Win Rate',-0.05),('Baseline',0.0),('+5% Win Rate',0.05),('+10% Win Rate',0.1)) v(scenario_name,d))
""")
oracle("scenario_deal_size_impact", """
SELECT scenario_name, d AS deal_size_delta_pct, ns AS projected_deal_size, ns*n AS projected_pipeline, ns*n*rate AS projected_revenue, ns*n*rate - size*n*rate AS revenue_delta
FROM (SELECT *, size*(1+d) AS ns FROM open_totals, (VALUES ('-15% Avg Deal Size',-0.15),('-10% Avg Deal Size',-0.1),('-5% Avg Deal Size',-0.05),('Baseline',0.0),('+5% Avg Deal Size',0.05),('+10% Avg Deal Size',0.1),('+15% Avg Deal Size',0.15)) v(scenario_name,d))
""")
oracle("scenario_cycle_time_impact", """
SELECT scenario_name, d AS cycle_days_delta, days+d AS projected_cycle_days, (-d/7)*0.01 AS win_rate_impact, nr AS projected_win_rate, pool*nr AS projected_revenue, pool*nr - pool*rate AS revenue_delta, (-d/7)*0.05 AS deals_per_quarter_change
FROM (SELECT *, least(1.0, greatest(0.0, rate+(-d/7)*0.01)) AS nr FROM open_totals, (VALUES ('14d slower',14),('7d slower',7),('Baseline',0),('7d faster',-7),('14d faster',-14)) v(scenario_name,d))
""")
oracle("scenario_summary", f"""
SELECT wb.projected_revenue AS baseline_revenue, wb.projected_win_rate AS baseline_win_rate, sb.projected_deal_size AS baseline_deal_size, w.scenario_name AS win_rate_best_scenario, w.revenue_delta AS win_rate_upside,
 {R("w.revenue_delta", "wb.projected_revenue", empty=0)} AS win_rate_upside_pct, s.scenario_name AS deal_size_best_scenario, s.revenue_delta AS deal_size_upside, {R("s.revenue_delta", "sb.projected_revenue", empty=0)} AS deal_size_upside_pct,
 t.scenario_name AS cycle_time_best_scenario, t.revenue_delta AS cycle_time_upside, w.revenue_delta+s.revenue_delta+t.revenue_delta AS total_upside_potential, $AS_OF AS snapshot_date
FROM (SELECT * FROM scenario_win_rate_impact WHERE scenario_name='Baseline') wb, (SELECT * FROM scenario_deal_size_impact WHERE scenario_name='Baseline') sb,
 (SELECT * FROM scenario_win_rate_impact ORDER BY projected_revenue DESC, scenario_name DESC LIMIT 1) w, (SELECT * FROM scenario_deal_size_impact ORDER BY projected_revenue DESC LIMIT 1) s,
 (SELECT * FROM scenario_cycle_time_impact ORDER BY projected_revenue DESC LIMIT 1) t
""")

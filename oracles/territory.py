from oracles import A, L, M, N, R, RD, S, oracle

oracle("account_scores", f"""
WITH b AS (SELECT a.*, d.* EXCLUDE (account_id), t.* EXCLUDE (account_id), ($AS_OF-last_touch)::INT AS quiet FROM accounts a
 LEFT JOIN (SELECT account_id, {N("is_won")} AS won, {S("amount", "is_won")} AS wv, {S("amount", "NOT is_closed")} AS pool FROM opportunities GROUP BY 1) d USING (account_id)
 LEFT JOIN (SELECT account_id, count(*) AS touches, {N("activity_type='Meeting'")} AS meetings, {N("activity_type='Email'")} AS emails, count(DISTINCT contact_id) AS contacts, max(activity_date) AS last_touch FROM activities GROUP BY 1) t USING (account_id)),
c AS (SELECT *, (CASE WHEN industry IN ('Technology','Financial Services','Healthcare') THEN 25 WHEN industry IN ('Manufacturing','Retail') THEN 20 ELSE 15 END
  + {L("employee_count", ">=", [(5000, 25), (1000, 20), (500, 15)], 10)} + {L("annual_revenue", ">=", [(1000000000, 25), (500000000, 20), (100000000, 15)], 10)})::INT AS firmographic_score,
 least(100.0, coalesce(won,0)*15 + CASE WHEN wv>=500000 THEN 30 WHEN wv>=100000 THEN 20 ELSE coalesce(wv,0)/10000 END + {L("quiet", "<=", [(30, 25), (90, 15)], 5)}) AS behavioral_score,
 least(100, coalesce(meetings,0)*5 + coalesce(emails,0)*2 + coalesce(contacts,0)*10) AS engagement_score,
 CASE WHEN pool>=500000 THEN 100 WHEN pool>=200000 THEN 75 WHEN pool>=50000 THEN 50 WHEN pool>0 THEN 25 ELSE 0 END AS pipeline_score FROM b),
d AS (SELECT *, {RD("firmographic_score*0.30 + behavioral_score*0.25 + engagement_score*0.25 + pipeline_score*0.20", 1)} AS propensity_score FROM c),
e AS (SELECT *, {L("propensity_score", ">=", [(70, "High"), (50, "Medium"), (30, "Low")], "Very Low")} AS propensity_tier FROM d)
SELECT account_id, account_name, industry, employee_count, annual_revenue, owner_id AS territory_owner_id, region AS territory, firmographic_score, behavioral_score, engagement_score, pipeline_score,
 propensity_score, propensity_tier, coalesce(wv,0) AS lifetime_value, coalesce(pool,0) AS open_pipeline, coalesce(touches,0) AS total_activities, coalesce(quiet,999) AS days_since_activity,
 CASE propensity_tier WHEN 'High' THEN CASE WHEN pool>0 THEN 'Accelerate existing deals' ELSE 'Initiate executive outreach' END
  WHEN 'Medium' THEN CASE WHEN quiet>60 THEN 'Re-engage with value content' ELSE 'Continue nurture sequence' END WHEN 'Low' THEN 'Add to awareness campaigns' ELSE 'Deprioritize or archive' END AS recommended_action,
 $AS_OF AS snapshot_date FROM e
""")

oracle("territory_balance", f"""
WITH h AS (SELECT territory_owner_id AS rep_id, territory, count(*) AS account_count, {N("propensity_tier='High'")} AS high_propensity_accounts, {N("propensity_tier='Medium'")} AS medium_propensity_accounts,
 {S("lifetime_value")} AS total_lifetime_value, {S("open_pipeline")} AS total_pipeline, {A("propensity_score", None, 1)} AS avg_propensity_score, {S("annual_revenue")} AS total_addressable_market FROM account_scores GROUP BY 1,2),
n AS (SELECT avg(account_count) AS an, {A("total_pipeline")} AS ap FROM h),
j AS (SELECT h.*, rep_name, segment, round((account_count-an)/greatest(an,1.0)*100,1) AS accounts_vs_avg, round((total_pipeline-ap)/greatest(ap,1.0)*100,1) AS pipeline_vs_avg,
 {R("total_pipeline", "quota_amount", None, 2, 0)} AS coverage_ratio, {R("total_addressable_market", "account_count", None, 0, 0)} AS tam_per_account, coalesce(quota_amount,0) AS quota, $AS_OF AS snapshot_date
 FROM h CROSS JOIN n LEFT JOIN quotas USING (rep_id) LEFT JOIN (SELECT rep_id, rep_name, segment FROM sales_reps) USING (rep_id))
SELECT *, CASE WHEN coverage_ratio>=3 AND high_propensity_accounts>=5 THEN 'Strong' WHEN coverage_ratio>=2 AND high_propensity_accounts>=3 THEN 'Healthy' WHEN coverage_ratio>=1 OR high_propensity_accounts>=2 THEN 'At Risk' ELSE 'Critical' END AS territory_health,
 CASE WHEN accounts_vs_avg>30 THEN 'Consider redistributing accounts - overloaded' WHEN accounts_vs_avg<-30 THEN 'Add accounts - capacity available' WHEN coverage_ratio<2 THEN 'Focus on pipeline generation' ELSE 'Territory balanced' END AS rebalance_recommendation FROM j
""")

oracle("white_space_analysis", f"""
WITH a AS (SELECT s.*, coalesce(n,0) AS products_purchased_count, coalesce(sp,0) AS total_spend, {L("annual_revenue", ">=", [(1000000000, 2000000), (500000000, 1000000), (100000000, 500000)], 200000)} AS estimated_potential
 FROM account_scores s LEFT JOIN (SELECT account_id, count(*) AS n, {S("amount")} AS sp FROM opportunities WHERE is_won GROUP BY 1) USING (account_id)),
b AS (SELECT *, greatest(round(estimated_potential-total_spend,2),0.0) AS white_space_value, round(total_spend/estimated_potential*100,1) AS wallet_share, 5-products_purchased_count AS products_available FROM a),
c AS (SELECT *, {L("wallet_share", "<", [(20, "High - Greenfield"), (50, "Medium - Expand"), (80, "Low - Optimize")], "Saturated")} AS expansion_opportunity, {L("products_available", ">=", [(4, "High"), (2, "Medium"), (1, "Low")], "None")} AS cross_sell_potential,
 CASE WHEN propensity_score>=60 AND total_spend>0 THEN 'High' WHEN propensity_score>=40 AND total_spend>0 THEN 'Medium' WHEN total_spend>0 THEN 'Low' ELSE 'N/A - No purchases' END AS upsell_potential FROM b),
d AS (SELECT *, CASE WHEN expansion_opportunity='High - Greenfield' AND propensity_tier='High' THEN 1 WHEN expansion_opportunity IN ('High - Greenfield','Medium - Expand') AND propensity_tier IN ('High','Medium') THEN 2 WHEN propensity_tier='High' THEN 3 ELSE 4 END AS priority_rank FROM c)
SELECT account_id, account_name, industry, territory, propensity_score, propensity_tier, total_spend, estimated_potential, white_space_value, wallet_share, expansion_opportunity, products_purchased_count, products_available,
 cross_sell_potential, upsell_potential, priority_rank, {M("priority_rank", {1: "Executive sponsorship + multi-product pitch", 2: "Solution expansion workshop", 3: "Use case discovery session"}, "Nurture with thought leadership")} AS recommended_play,
 open_pipeline, $AS_OF AS snapshot_date FROM d
""")

oracle("territory_summary", f"""
WITH t AS (SELECT count(*) AS total_territories, coalesce(sum(account_count),0)::BIGINT AS total_accounts, {S("total_pipeline")} AS total_pipeline, {S("quota")} AS total_quota, coalesce({A("coverage_ratio")},0) AS cover,
 {N("territory_health='Strong'")} AS strong_territories, {N("territory_health='Critical'")} AS critical_territories FROM territory_balance),
w AS (SELECT {S("white_space_value")} AS total_white_space_value, {S("white_space_value", "expansion_opportunity='High - Greenfield'")} AS greenfield_opportunity, {N("priority_rank=1")} AS priority_accounts, round(coalesce({A("wallet_share", None, 1)},0),1) AS avg_wallet_share FROM white_space_analysis),
s AS (SELECT round(coalesce({A("propensity_score", None, 1)},0),1) AS avg_propensity_score, {N("propensity_tier='High'")} AS high_propensity_accounts, {N("propensity_tier='Medium'")} AS medium_propensity_accounts, {N("propensity_tier='Low'")} AS low_propensity_accounts FROM account_scores),
x AS (SELECT *, critical_territories/greatest(total_territories,1) AS bad FROM t, w, s)
SELECT * EXCLUDE (cover, bad), round(cover,2) AS avg_coverage_ratio, CASE WHEN cover>=3 AND bad<0.1 THEN 'Strong' WHEN cover>=2 AND bad<0.2 THEN 'Healthy' WHEN cover>=1.5 THEN 'At Risk' ELSE 'Critical' END AS overall_health,
 CASE WHEN cover>=3 AND bad<0.1 THEN 'A' WHEN cover>=2 AND bad<0.2 THEN 'B' WHEN cover>=1.5 THEN 'C' ELSE 'D' END AS health_grade,
 'Total addressable white space of $' || printf('%.1f', total_white_space_value/1000000) || 'M across ' || total_accounts || ' accounts.' AS insight_1, high_propensity_accounts || ' high-propensity accounts identified for prioritized outreach.' AS insight_2,
 critical_territories || ' territories need immediate attention due to low coverage.' AS insight_3,
 CASE WHEN priority_accounts>0 THEN 'Focus expansion efforts on priority 1 accounts with high propensity and low wallet share.' ELSE 'Build pipeline in underpenetrated accounts.' END AS recommendation_1,
 CASE WHEN bad>0.15 THEN 'Rebalance territories with >30% deviation from average account load.' ELSE 'Maintain current territory assignments.' END AS recommendation_2,
 CASE WHEN cover<2 THEN 'Accelerate deals in territories with <2x coverage to reduce risk.' ELSE 'Continue pipeline generation across all territories.' END AS recommendation_3, $AS_OF AS snapshot_date FROM x
""")

oracle("rep_capacity_model", f"""
WITH b AS (SELECT u.rep_id, rep_name, region, segment, start_date AS hire_date, ($AS_OF-start_date)::INT AS days_since_hire, quota_amount, won, pool, na, health,
 least(round(na/50,2),1.5) AS capacity_utilization FROM enriched_users u LEFT JOIN quotas q USING (rep_id)
 LEFT JOIN (SELECT owner_id AS rep_id, {S("amount", "is_won")} AS won, {S("amount", "NOT is_closed")} AS pool, count(DISTINCT account_id) AS na, avg(health_score) AS health FROM deal_health WHERE close_date >= $AS_OF - 90 GROUP BY 1) m USING (rep_id)),
c AS (SELECT *, {L("days_since_hire", "<", [(90, "Ramping"), (180, "Developing")], "Fully Ramped")} AS ramp_status, {L("days_since_hire", "<", [(30, 0.25), (60, 0.5), (90, 0.75), (180, 0.9)], 1.0)} AS ramp_factor FROM b),
d AS (SELECT *, round(quota_amount*ramp_factor,0) AS effective_quota FROM c)
SELECT rep_id, rep_name, region, segment, hire_date, days_since_hire, ramp_status, ramp_factor, quota_amount, effective_quota, coalesce(won,0) AS closed_won_90d, coalesce(pool,0) AS open_pipeline,
 round(coalesce(won,0)/effective_quota,3) AS quota_attainment, round(coalesce(pool,0)/effective_quota,2) AS coverage_ratio, coalesce(na,0) AS active_accounts, capacity_utilization, round(1.0-capacity_utilization,2) AS capacity_headroom,
 {L("capacity_utilization", ">", [(1.2, "Over Capacity"), (0.9, "At Capacity"), (0.6, "Healthy")], "Under Utilized")} AS capacity_status, round(coalesce(won,0)/effective_quota*(coalesce(health,50)/100),2) AS productivity_index,
 coalesce(health,50) AS avg_deal_health FROM d
""")
HEAD = f"""count(*) AS total_reps, {N("ramp_status='Fully Ramped'")} AS ramped_reps, {N("ramp_status='Ramping'")} AS ramping_reps, {N("ramp_status='Developing'")} AS developing_reps, {S("quota_amount")} AS total_quota,
 {S("effective_quota")} AS effective_quota, {S("closed_won_90d")} AS total_closed_won, {S("open_pipeline")} AS total_pipeline, {N("capacity_status='Over Capacity'")} AS over_capacity_count, {N("capacity_status='Under Utilized'")} AS under_utilized_count"""
oracle("team_capacity_summary", f"""
WITH a AS (SELECT region, segment, {HEAD}, sum(active_accounts)::BIGINT AS total_active_accounts, {A("capacity_utilization")} AS avg_capacity_utilization, {A("productivity_index")} AS avg_productivity FROM rep_capacity_model GROUP BY 1,2),
b AS (SELECT *, round(total_closed_won/effective_quota,3) AS team_attainment, round(total_pipeline/effective_quota,2) AS team_coverage_ratio, round(total_quota-effective_quota,0) AS ramp_capacity_loss, round(total_active_accounts/total_reps,0) AS avg_accounts_per_rep FROM a),
c AS (SELECT *, CASE WHEN avg_capacity_utilization>1 AND team_coverage_ratio<2.5 THEN 'Critical' WHEN avg_capacity_utilization>0.9 THEN 'High' WHEN avg_capacity_utilization>0.7 THEN 'Medium' ELSE 'Low' END AS hiring_need_score FROM b)
SELECT *, CASE hiring_need_score WHEN 'Critical' THEN ceil(total_reps*0.3) WHEN 'High' THEN ceil(total_reps*0.2) WHEN 'Medium' THEN ceil(total_reps*0.1) ELSE 0 END::BIGINT AS recommended_hires,
 CASE WHEN avg_capacity_utilization BETWEEN 0.7 AND 1.0 AND team_coverage_ratio>=3 THEN 'Strong' WHEN avg_capacity_utilization BETWEEN 0.5 AND 1.1 THEN 'Healthy' WHEN avg_capacity_utilization>1.1 THEN 'Strained' ELSE 'Under Utilized' END AS capacity_health FROM c
""")
COH = [("0-30 days", 30, 0.10), ("30-60 days", 60, 0.25), ("60-90 days", 90, 0.50), ("90-120 days", 120, 0.75), ("120-180 days", 180, 0.90)]
oracle("ramp_time_analysis", f"""
SELECT *, round(avg_attainment-expected_attainment,3) AS performance_vs_expected FROM (SELECT *, {M("ramp_cohort", {n: e for n, _, e in COH}, 1.0)} AS expected_attainment, {M("ramp_cohort", {c[0]: i + 1 for i, c in enumerate(COH)}, 6)} AS cohort_order
FROM (SELECT {L("days_since_hire", "<", [(t, n) for n, t, _ in COH], "180+ days")} AS ramp_cohort, count(*) AS rep_count, {A("quota_attainment", None, 3)} AS avg_attainment, {A("productivity_index")} AS avg_productivity, {A("coverage_ratio")} AS avg_coverage,
 avg(active_accounts) AS avg_accounts, avg(days_since_hire-45) FILTER (WHERE closed_won_90d>0) AS avg_days_to_first_close FROM rep_capacity_model GROUP BY 1))
""")
oracle("hiring_impact_model", """
SELECT *, round(projected_revenue_y1/nullif(total_investment,0),2) AS roi_y1, CASE WHEN recommended_hires>0 THEN round(total_investment/(projected_revenue_y1/12),0) ELSE 0.0 END AS months_to_breakeven
FROM (SELECT *, ceil(current_capacity_gap/nullif(pipeline_per_hire_y1,0))::BIGINT AS hires_to_close_gap, recommended_hires*quota_per_hire_y1 AS projected_revenue_y1, recommended_hires*pipeline_per_hire_y1 AS projected_pipeline_y1
FROM (SELECT *, round(quota_per_hire_y1*3.0,0) AS pipeline_per_hire_y1 FROM (SELECT *, round(avg_rep_quota*0.5,0) AS quota_per_hire_y1 FROM (SELECT *, round(total_quota/total_reps,0) AS avg_rep_quota,
 greatest(round(total_quota*3.0-total_pipeline,0),0.0) AS current_capacity_gap, 150000 AS investment_per_hire, recommended_hires*150000 AS total_investment FROM team_capacity_summary))))
""")
oracle("capacity_planning_summary", f"""
SELECT *, CASE WHEN avg_utilization BETWEEN 0.7 AND 1.0 AND coverage_ratio>=3 AND over_capacity_count=0 THEN 'Strong' WHEN avg_utilization BETWEEN 0.5 AND 1.1 THEN 'Healthy' WHEN avg_utilization>1.1 THEN 'Strained' ELSE 'Under Utilized' END AS capacity_health
FROM (SELECT *, round(total_closed_won/effective_quota,3) AS team_attainment, round(total_pipeline/effective_quota,2) AS coverage_ratio, round((total_quota-effective_quota)/total_quota,3) AS ramp_capacity_loss_pct,
 CASE WHEN over_capacity_count>total_reps*0.3 THEN 'Critical' WHEN over_capacity_count>total_reps*0.2 THEN 'High' WHEN over_capacity_count>0 THEN 'Medium' ELSE 'Low' END AS hiring_urgency, $AS_OF AS snapshot_date
 FROM (SELECT {HEAD}, {A("capacity_utilization")} AS avg_utilization, {A("productivity_index")} AS avg_productivity FROM rep_capacity_model),
 (SELECT sum(recommended_hires)::BIGINT AS total_recommended_hires, sum(total_investment)::BIGINT AS total_hiring_investment, {S("projected_revenue_y1")} AS total_projected_revenue, {S("current_capacity_gap")} AS total_capacity_gap FROM hiring_impact_model))
""")

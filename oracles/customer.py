from oracles import A, L, M, N, QUARTER_AS_OF, R, RD, S, oracle

IN_Q = "close_date BETWEEN DATE '2001-10-01' AND DATE '2001-12-31'"
BAND = [(80, "Healthy"), (60, "Monitor"), (40, "At Risk")]

oracle("customer_health_scores", f"""
WITH b AS (SELECT a.* EXCLUDE (health_score), meetings, contacts, ($AS_OF-last_touch)::INT AS quiet, pool FROM accounts a
 LEFT JOIN (SELECT account_id, {N("activity_type='Meeting'")} AS meetings, max(activity_date) AS last_touch, count(DISTINCT contact_id) AS contacts FROM activities GROUP BY 1) t USING (account_id)
 LEFT JOIN (SELECT account_id, {S("amount", "NOT is_closed")} AS pool FROM deal_health GROUP BY 1) d USING (account_id) WHERE current_arr>0),
c AS (SELECT *, least(round((coalesce(meetings,0)*10+coalesce(contacts,0)*15)/2,0),100.0) AS engagement_score, {L("quiet", "<=", [(14, 100), (30, 80), (60, 60), (90, 40)], 20)} AS relationship_score,
 CASE WHEN pool>current_arr*0.5 THEN 100 WHEN pool>current_arr*0.25 THEN 80 WHEN pool>0 THEN 60 ELSE 40 END AS financial_score, 70 AS support_score FROM b),
d AS (SELECT *, {RD("engagement_score*0.30 + relationship_score*0.25 + financial_score*0.25 + support_score*0.20", 1)} AS health_score FROM c)
SELECT account_id, account_name, industry, segment, current_arr, health_score, {L("health_score", ">=", BAND, "Critical")} AS health_tier, engagement_score, relationship_score, financial_score, support_score,
 {L("health_score", ">=", [(80, "Low"), (60, "Medium"), (40, "High")], "Critical")} AS churn_risk, renewal_date, (renewal_date-$AS_OF)::INT AS days_to_renewal, coalesce(quiet,999) AS days_since_activity, coalesce(contacts,0) AS contacts_engaged, coalesce(pool,0) AS open_pipeline FROM d
""")
oracle("expansion_opportunities", f"""
WITH s AS (SELECT *, {RD("health_score*0.40 + CASE WHEN open_pipeline>0 THEN 30 ELSE 0 END + CASE WHEN contacts_engaged>=3 THEN 20 ELSE contacts_engaged*7 END + CASE WHEN days_since_activity<=14 THEN 10 ELSE 0 END", 1)} AS expansion_score FROM customer_health_scores)
SELECT *, round(current_arr*expansion_score/100,0) AS expansion_potential, {L("expansion_score", ">=", [(80, "High"), (60, "Medium"), (40, "Low")], "None")} AS expansion_tier,
 CASE WHEN health_score>=80 AND open_pipeline=0 THEN 'Initiate expansion conversation - healthy account with no active deals' WHEN health_score>=60 AND open_pipeline>0 THEN 'Accelerate existing opportunity - good health, deal in progress'
  WHEN health_score<60 AND churn_risk IN ('High','Critical') THEN 'Focus on retention before expansion - address churn risk first' ELSE 'Monitor and nurture - build relationship before expansion' END AS recommended_play,
 (row_number() OVER (ORDER BY expansion_score DESC, current_arr DESC, account_id))::BIGINT AS priority_rank FROM s
""")
oracle("churn_risk_analysis", """
WITH s AS (SELECT *, concat_ws(', ', CASE WHEN days_since_activity>30 THEN 'No recent engagement' END, CASE WHEN contacts_engaged<2 THEN 'Single-threaded' END, CASE WHEN engagement_score<50 THEN 'Low engagement' END, CASE WHEN days_to_renewal<90 THEN 'Renewal approaching' END) AS risk_factors,
 round(CASE churn_risk WHEN 'Critical' THEN current_arr WHEN 'High' THEN current_arr*0.7 ELSE current_arr*0.3 END,3) AS arr_at_risk, CASE churn_risk WHEN 'Critical' THEN 0.3 WHEN 'High' THEN 0.5 ELSE 0.7 END AS save_probability,
 CASE WHEN churn_risk='Critical' THEN 'Immediate executive outreach required' WHEN churn_risk='High' AND days_to_renewal<90 THEN 'Schedule urgent renewal review meeting' WHEN days_since_activity>60 THEN 'Re-engagement campaign - customer going dark' ELSE 'Increase touchpoint frequency' END AS recommended_action,
 CASE WHEN churn_risk='Critical' OR days_to_renewal<30 THEN 'Immediate' WHEN churn_risk='High' OR days_to_renewal<60 THEN 'This Week' ELSE 'This Month' END AS urgency FROM customer_health_scores WHERE churn_risk IN ('High','Critical'))
SELECT *, (row_number() OVER (ORDER BY CASE WHEN churn_risk='Critical' THEN 1 ELSE 2 END, arr_at_risk DESC, account_id))::BIGINT AS priority_rank FROM s
""")
oracle("customer_health_summary", f"""
SELECT *, round((total_arr+total_expansion_potential-total_arr_at_risk)/total_arr,3) AS net_retention_forecast, $AS_OF AS snapshot_date FROM
(SELECT count(*) AS total_customers, {S("current_arr")} AS total_arr, {A("health_score", None, 1)} AS avg_health_score, {N("health_tier='Healthy'")} AS healthy_count, {N("health_tier='Monitor'")} AS monitor_count, {N("health_tier='At Risk'")} AS at_risk_count,
 {N("health_tier='Critical'")} AS critical_count, {S("current_arr", "health_tier='Healthy'")} AS healthy_arr, {S("current_arr", "health_tier IN ('At Risk','Critical')")} AS at_risk_arr, {N("days_to_renewal<=90")} AS renewals_90d, {S("current_arr", "days_to_renewal<=90")} AS renewal_arr_90d FROM customer_health_scores),
(SELECT {S("expansion_potential")} AS total_expansion_potential, {N("expansion_tier='High'")} AS high_expansion_count, {S("expansion_potential", "expansion_tier='High'")} AS high_expansion_value FROM expansion_opportunities),
(SELECT count(*) AS churn_risk_count, {S("arr_at_risk", None, 3)} AS total_arr_at_risk FROM churn_risk_analysis)
""")
oracle("customer_health_details", f"""
WITH b AS (SELECT account_id, account_name, segment, industry, region, current_arr, account_tier, o.* EXCLUDE (account_id), ($AS_OF-last_purchase_date)::INT AS days_since_last_purchase, ($AS_OF-first_purchase_date)::INT AS tenure_days FROM enriched_accounts
 LEFT JOIN (SELECT account_id, {S("amount", "is_won")} AS lifetime_value, {N("is_won")} AS purchases, {A("amount", "is_won")} AS avg_purchase, max(close_date) FILTER (WHERE is_won) AS last_purchase_date, min(close_date) FILTER (WHERE is_won) AS first_purchase_date FROM opportunities GROUP BY 1) o USING (account_id) WHERE is_customer),
c AS (SELECT *, CASE WHEN tenure_days>0 THEN round(purchases/(tenure_days/365.0),2) ELSE 0.0 END AS purchase_frequency FROM b),
d AS (SELECT *, {L("days_since_last_purchase", "<=", [(30, 100), (90, 75), (180, 50), (365, 25)], 10)} AS recency_score, {L("purchase_frequency", ">=", [(4, 100), (2, 75), (1, 50)], 25)} AS frequency_score, {L("lifetime_value", ">=", [(500000, 100), (100000, 75), (50000, 50)], 25)} AS monetary_score FROM c),
e AS (SELECT *, {RD("recency_score*0.4 + frequency_score*0.3 + monetary_score*0.3", 0)} AS health_score FROM d)
SELECT *, {L("health_score", ">=", BAND, "Critical")} AS health_status, days_since_last_purchase>365 AS churned, $AS_OF AS snapshot_date FROM e
""")
oracle("win_loss_details", f"""
WITH b AS (SELECT o.opportunity_id, account_id, owner_id, segment, industry, amount, created_date, close_date, is_won, days_to_close, stakeholder_count, has_champion, is_competitive, discount_percent, t.* EXCLUDE (opportunity_id),
 CASE WHEN days_to_close>0 THEN round(total_activities/days_to_close*30,2) ELSE 0.0 END AS activity_density, CASE WHEN total_activities>0 THEN round(meetings/total_activities*100,1) ELSE 0.0 END AS meeting_ratio FROM opportunities o
 LEFT JOIN (SELECT opportunity_id, count(*) AS total_activities, count(DISTINCT activity_type) AS activity_types, {N("activity_type='Call'")} AS calls, {N("activity_type='Email'")} AS emails, {N("activity_type='Meeting'")} AS meetings, {N("activity_type='Demo'")} AS demos,
 min(activity_date) AS first_activity_date, max(activity_date) AS final_activity_date FROM activities GROUP BY 1) t USING (opportunity_id) WHERE is_closed)
SELECT *, demos>0 AS demo_conducted, activity_types>=3 AS multi_touch, {L("days_to_close", "<=", [(30, 100), (60, 75), (90, 50), (120, 25)], 10)} AS velocity_score, {L("stakeholder_count", ">=", [(5, 100), (3, 75), (2, 50)], 25)} AS stakeholder_score,
 {L("amount", ">=", [(500000, "Enterprise"), (100000, "Mid-Market")], "SMB")} AS deal_size_bucket, CASE WHEN is_won THEN 'Won' ELSE 'Lost' END AS outcome, 'Q' || quarter(close_date) || ' ' || year(close_date) AS close_quarter, $AS_OF AS snapshot_date,
 {L("activity_density", ">=", [(5, 100), (3, 75), (1, 50)], 25)} AS engagement_score FROM b
""")

oracle("funnel_handoff_metrics", f"""
WITH a AS (SELECT lead_source, segment, count(*) AS total_leads, {N("status='MQL'")} AS mql_count, {N("status='SQL'")} AS sql_count, {N("status='Qualified'")} AS qualified_count, {N("status='Converted'")} AS converted_count, {N("status='Disqualified'")} AS disqualified_count,
 avg(lead_score) AS avg_lead_score, avg(first_response_date::DATE - created_date::DATE) AS avg_response_time_days FROM leads GROUP BY 1,2),
b AS (SELECT *, {R("mql_count", "total_leads", empty=0)} AS mql_rate, {R("sql_count", "mql_count", empty=0)} AS mql_to_sql_rate, {R("qualified_count", "sql_count", empty=0)} AS sql_to_qualified_rate, {R("converted_count", "qualified_count", empty=0)} AS qualified_to_converted_rate,
 {R("converted_count", "total_leads", empty=0)} AS overall_conversion_rate, {R("disqualified_count", "total_leads", empty=0)} AS disqualification_rate FROM a)
SELECT *, {L("mql_rate", ">=", [(0.25, "HEALTHY"), (0.15, "MONITOR")], "AT_RISK")} AS mql_rate_health, {L("mql_to_sql_rate", ">=", [(0.4, "HEALTHY"), (0.25, "MONITOR")], "AT_RISK")} AS mql_to_sql_health,
 {L("avg_response_time_days", "<=", [(1, "HEALTHY"), (3, "MONITOR")], "AT_RISK")} AS response_time_health, $AS_OF AS snapshot_date FROM b
""")
BK = [(1, "Within 1 Hour"), (4, "1-4 Hours"), (24, "4-24 Hours"), (72, "1-3 Days")]
oracle("lead_response_analytics", f"""
WITH f AS (SELECT lead_id, min(activity_date) AS ft FROM lead_touches WHERE activity_type IN ('Call','Email','Meeting') GROUP BY 1),
b AS (SELECT *, CASE WHEN sec IS NULL THEN 'No Response' ELSE {L("sec/3600", "<=", BK, "3+ Days")} END AS response_time_bucket FROM (SELECT l.*, datesub('second', created_date, ft) AS sec FROM leads l LEFT JOIN f USING (lead_id))),
c AS (SELECT lead_source, segment, response_time_bucket, count(*) AS lead_count, avg(sec)/3600 AS avg_response_hours, avg(lead_score) AS avg_lead_score, {N("status='Converted'")} AS converted_count FROM b GROUP BY 1,2,3)
SELECT *, {R("converted_count", "lead_count", empty=0)} AS conversion_rate, {M("response_time_bucket", {"Within 1 Hour": "HIGH_POSITIVE", "1-4 Hours": "POSITIVE", "4-24 Hours": "NEUTRAL", "1-3 Days": "NEGATIVE", "3+ Days": "HIGH_NEGATIVE"}, "UNKNOWN")} AS speed_impact FROM c
""")
oracle("cross_team_activity", f"""
SELECT opportunity_id, account_name, stage_name, amount, coalesce(m,0) AS marketing_touches, coalesce(s,0) AS sales_touches, coalesce(c,0) AS cs_touches, coalesce(n,0) AS total_touches, coalesce(t,1) AS teams_engaged,
 CASE WHEN t>=3 THEN 'FULL' WHEN t=2 THEN 'PARTIAL' ELSE 'SINGLE' END AS multi_team_engagement, coalesce(m,0)*0.2 + coalesce(s,0)*0.5 + coalesce(c,0)*0.3 AS engagement_score, coalesce(health_score,50) AS health_score, (stage_name='Closed Won')::INT AS is_won
FROM deal_health LEFT JOIN (SELECT opportunity_id, {N("team='MARKETING'")} AS m, {N("team='SALES'")} AS s, {N("team='CUSTOMER_SUCCESS'")} AS c, count(*) AS n, count(DISTINCT team) AS t FROM (SELECT *, CASE WHEN activity_type IN ('Webinar','Event','Marketing Email') THEN 'MARKETING'
 WHEN activity_type IN ('Call','Email','Meeting','Demo') THEN 'SALES' WHEN activity_type IN ('Onboarding','Training','Support') THEN 'CUSTOMER_SUCCESS' ELSE 'OTHER' END AS team FROM activities) GROUP BY 1) USING (opportunity_id)
""")
DROPS = [("drop_lead_to_mql", "Lead→MQL", "total_leads-mql_count"), ("drop_mql_to_sql", "MQL→SQL", "mql_count-sql_count"), ("drop_sql_to_opp", "SQL→Opp", "sql_count-opp_count"), ("drop_opp_to_qualified", "Opp→Qualified", "opp_count-qualified_opp_count"),
         ("drop_qualified_to_proposal", "Qualified→Proposal", "qualified_opp_count-proposal_count"), ("drop_proposal_to_negotiation", "Proposal→Negotiation", "proposal_count-negotiation_count"), ("drop_negotiation_to_won", "Negotiation→Won", "negotiation_count-won_count")]
oracle("funnel_drop_analysis", f"""
WITH l AS (SELECT segment, lead_source, count(*) AS total_leads, {N("status='MQL'")} AS mql_count, {N("status='SQL'")} AS sql_count, {N("status='Converted'")} AS converted_count FROM leads GROUP BY 1,2),
o AS (SELECT segment, lead_source, count(*) AS opp_count, {N("stage_name IN ('Solution Design','Proposal','Negotiation','Closed Won')")} AS qualified_opp_count, {N("stage_name IN ('Proposal','Negotiation','Closed Won')")} AS proposal_count,
 {N("stage_name IN ('Negotiation','Closed Won')")} AS negotiation_count, {N("is_won")} AS won_count, {S("amount", "is_won")} AS won_amount FROM opportunities GROUP BY 1,2),
j AS (SELECT l.*, {", ".join(f"coalesce({c},0) AS {c}" for c in ("opp_count", "qualified_opp_count", "proposal_count", "negotiation_count", "won_count", "won_amount"))} FROM l LEFT JOIN o USING (segment, lead_source)),
k AS (SELECT *, {", ".join(f"{e} AS {n}" for n, _, e in DROPS)}, {R("won_count", "total_leads", empty=0)} AS overall_conversion_rate FROM j)
SELECT *, CASE greatest({", ".join(n for n, _, _ in DROPS)}) {" ".join(f"WHEN {n} THEN '{t}'" for n, t, _ in DROPS)} END AS largest_drop_stage FROM k
""")
oracle("telemetry_summary", f"""
WITH h AS (SELECT coalesce(sum(total_leads),0)::BIGINT AS total_leads, coalesce(sum(mql_count),0)::BIGINT AS total_mqls, coalesce(sum(sql_count),0)::BIGINT AS total_sqls, coalesce(sum(converted_count),0)::BIGINT AS total_converted, coalesce({A("mql_to_sql_rate", None, 6)},0) AS mql_to_sql_rate,
 coalesce({A("overall_conversion_rate", None, 6)},0) AS overall_conversion_rate, {A("avg_response_time_days", None, 6)} AS wait FROM funnel_handoff_metrics),
s AS (SELECT coalesce(sum(lead_count) FILTER (WHERE response_time_bucket='Within 1 Hour'),0)::BIGINT AS fast, coalesce(sum(lead_count) FILTER (WHERE response_time_bucket IN ('3+ Days','No Response')),0)::BIGINT AS slow_response_count, sum(lead_count)::BIGINT AS answered FROM lead_response_analytics),
e AS (SELECT coalesce({A("engagement_score", None, 1)},0) AS avg_engagement_score, coalesce(avg(total_touches),0) AS avg_touches_per_deal, {N("multi_team_engagement='FULL'")}/greatest(count(*),1) AS full_engagement_pct,
 coalesce(avg(health_score) FILTER (WHERE multi_team_engagement='FULL'),0) AS full_engagement_health_avg, coalesce(avg(health_score) FILTER (WHERE multi_team_engagement='SINGLE'),0) AS single_engagement_health_avg FROM cross_team_activity),
x AS (SELECT *, fast/greatest(coalesce(answered,1),1) AS fast_response_pct, coalesce(wait,0) AS avg_response_days, full_engagement_health_avg-single_engagement_health_avg AS health_delta FROM h, s, e),
y AS (SELECT *, {L("mql_to_sql_rate", ">=", [(0.35, "HEALTHY"), (0.25, "MONITOR")], "AT_RISK")} AS mql_to_sql_health, {L("coalesce(wait,99)", "<=", [(1, "HEALTHY"), (3, "MONITOR")], "AT_RISK")} AS response_health,
 {L("fast_response_pct", ">=", [(0.5, "HEALTHY"), (0.25, "MONITOR")], "AT_RISK")} AS speed_to_lead_health, {L("full_engagement_pct", ">=", [(0.4, "HEALTHY"), (0.2, "MONITOR")], "AT_RISK")} AS team_alignment_health FROM x),
z AS (SELECT *, ({" + ".join(M(v, {"HEALTHY": 3, "MONITOR": 2}, 1) for v in ("mql_to_sql_health", "response_health", "speed_to_lead_health", "team_alignment_health"))})/4 AS sc,
 CASE WHEN mql_to_sql_health='AT_RISK' THEN 'MQL to SQL Conversion' WHEN speed_to_lead_health='AT_RISK' THEN 'Speed to Lead' WHEN team_alignment_health='AT_RISK' THEN 'Multi-Team Engagement' ELSE 'None identified' END AS primary_bottleneck FROM y)
SELECT * EXCLUDE (wait, fast, answered, sc), {L("sc", ">=", [(2.5, "HEALTHY"), (1.75, "MONITOR")], "AT_RISK")} AS overall_health,
 {M("primary_bottleneck", {"MQL to SQL Conversion": "Review lead scoring criteria and SDR qualification process. Consider tightening MQL definition or improving SDR training.", "Speed to Lead": "Implement automated lead routing and alerts. Set SLA for first touch within 1 hour of MQL.", "Multi-Team Engagement": "Establish joint account planning between Sales and CS. Create triggers for CS involvement in late-stage deals.", "None identified": "Funnel health is good. Focus on maintaining current performance and scaling volume."})} AS recommendation,
 $AS_OF AS snapshot_date FROM z
""")

oracle("qbr_performance_summary", f"""
SELECT *, {L("quota_attainment", ">=", [(1.1, "Top Performer"), (0.9, "On Track"), (0.7, "Needs Improvement")], "At Risk")} AS performance_tier FROM (
SELECT m.*, quota_amount, region, segment, {R("won_count", "won_count+lost_count", empty=0)} AS win_rate, {R("closed_won", "quota_amount", empty=0)} AS quota_attainment, quota_amount-closed_won AS gap_to_quota, {QUARTER_AS_OF} AS quarter
FROM (SELECT owner_id, owner_name, {S("amount", "is_won")} AS closed_won, {S("amount", "stage_name<>'Closed Lost'")} AS open_pipeline, count(*) AS total_deals, {N("is_won")} AS won_count, {N("stage_name='Closed Lost'")} AS lost_count, {A("amount")} AS avg_deal_size,
 avg(close_date-created_date) FILTER (WHERE is_won) AS avg_sales_cycle FROM opportunities WHERE {IN_Q} GROUP BY 1,2) m LEFT JOIN quotas q ON q.rep_id=owner_id LEFT JOIN (SELECT rep_id, region, segment FROM sales_reps) r ON r.rep_id=owner_id)
""")
GR = [(85, "A"), (70, "B"), (55, "C"), (40, "D")]
AG = [(0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D")]
oracle("qbr_pipeline_health", f"""
SELECT *, {QUARTER_AS_OF} AS quarter, healthy_pipeline/greatest(total_pipeline,1.0) AS healthy_pct, monitor_pipeline/greatest(total_pipeline,1.0) AS monitor_pct, at_risk_pipeline/greatest(total_pipeline,1.0) AS at_risk_pct, {L("avg_health_score", ">=", GR, "F")} AS pipeline_health_grade
FROM (SELECT count(*) AS total_opportunities, {S("amount")} AS total_pipeline, coalesce({A("amount")},0) AS avg_deal_size, coalesce(avg(health_score),0) AS avg_health_score, {S("amount", "health_score>=70")} AS healthy_pipeline, {S("amount", "health_score>=50 AND health_score<70")} AS monitor_pipeline,
 {S("amount", "health_score<50")} AS at_risk_pipeline FROM deal_health WHERE {IN_Q} AND NOT is_closed), (SELECT coalesce(avg_hygiene_score,70) AS hygiene_score FROM pipeline_hygiene_summary)
""")
oracle("qbr_forecast_accuracy", f"""
SELECT *, {L("accuracy_score", ">=", AG, "F")} AS accuracy_grade FROM (SELECT week_number, week_label, forecast_amount, actual_amount, round(forecast_amount-actual_amount,4) AS variance, (forecast_amount-actual_amount)/greatest(forecast_amount,1.0) AS variance_pct,
 least(CASE WHEN week_number>4 THEN 1-abs(forecast_amount-actual_amount)/greatest(forecast_amount,1.0) ELSE 0.0 END, 1.0) AS accuracy_score, {QUARTER_AS_OF} AS quarter
FROM (SELECT week_number, 'Week ' || week_number AS week_label, round(closed_won+ai_forecast,4) AS forecast_amount, closed_won AS actual_amount FROM forecast_history))
""")
_side = lambda n, p: f"""{N(p)} AS {n}_count, {S("amount", p)} AS {n}_revenue, coalesce({A("amount", p)},0) AS {n}_avg_deal_size, coalesce(avg(n) FILTER (WHERE {p}),0) AS {n}_avg_activities, coalesce(avg(meetings) FILTER (WHERE {p}),0) AS {n}_avg_meetings, coalesce(avg(close_date-created_date) FILTER (WHERE {p}),0) AS {n}_avg_cycle"""
oracle("qbr_win_loss_analysis", f"""
WITH c AS (SELECT o.*, n, meetings FROM opportunities o LEFT JOIN (SELECT opportunity_id, count(*) AS n, {N("activity_type='Meeting'")} AS meetings FROM activities GROUP BY 1) t USING (opportunity_id) WHERE {IN_Q} AND is_closed),
r AS (SELECT loss_reason, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, loss_reason) AS rn FROM c WHERE loss_reason IS NOT NULL GROUP BY 1),
s AS (SELECT {_side("wins", "is_won")}, {_side("losses", "NOT is_won")} FROM c)
SELECT *, {QUARTER_AS_OF} AS quarter, wins_count/greatest(wins_count+losses_count,1) AS win_rate, {", ".join(f"coalesce((SELECT loss_reason FROM r WHERE rn={i}),'Unknown') AS top_loss_reason_{i}, coalesce((SELECT k FROM r WHERE rn={i})/greatest(losses_count,1),0)::DOUBLE AS top_loss_reason_{i}_pct" for i in (1, 2, 3))},
 wins_avg_activities-losses_avg_activities AS activity_delta, wins_avg_meetings-losses_avg_meetings AS meeting_delta, losses_avg_cycle-wins_avg_cycle AS cycle_delta FROM s
""")
oracle("qbr_executive_summary", f"""
WITH t AS (SELECT {S("closed_won")} AS total_closed_won, {S("quota_amount")} AS total_quota, coalesce({A("quota_attainment", None, 6)},0) AS avg_rep_attainment, {N("performance_tier='Top Performer'")} AS top_performers, {N("performance_tier='At Risk'")} AS at_risk_reps, count(*) AS total_reps FROM qbr_performance_summary),
p AS (SELECT quarter, total_pipeline, avg_health_score, at_risk_pipeline, hygiene_score, at_risk_pct AS risk FROM qbr_pipeline_health),
f AS (SELECT accuracy_score AS forecast_accuracy FROM qbr_forecast_accuracy WHERE week_number=12),
w AS (SELECT win_rate, wins_avg_deal_size AS avg_deal_size, wins_avg_cycle AS avg_sales_cycle, top_loss_reason_1 AS top_loss_reason, activity_delta AS delta FROM qbr_win_loss_analysis),
x AS (SELECT *, total_closed_won/greatest(total_quota,1.0) AS team_attainment FROM t,p,f,w),
y AS (SELECT *, least(avg_rep_attainment/0.8,1.0)*25 + least(avg_health_score/80,1.0)*25 + forecast_accuracy*25 + least(win_rate/0.4,1.0)*25 AS overall_health_score, {L("forecast_accuracy", ">=", AG, "F")} AS forecast_grade,
 list_filter([CASE WHEN team_attainment>=0.9 THEN 'Team is on track at ' || printf('%.0f',team_attainment*100) || '% of quota with strong performer distribution.' WHEN team_attainment>=0.7 THEN 'Team at ' || printf('%.0f',team_attainment*100) || '% of quota. Gap of $' || format('{{:,}}', round_even(total_quota-total_closed_won,0)::BIGINT) || ' needs to be addressed in remaining weeks.'
  ELSE 'Team significantly behind at ' || printf('%.0f',team_attainment*100) || '% of quota. Urgent intervention required.' END,
  CASE WHEN risk>0.3 THEN printf('%.0f',risk*100) || '% of pipeline is at risk ($' || format('{{:,}}', round_even(at_risk_pipeline,0)::BIGINT) || '). Focus on deal acceleration and risk mitigation.' WHEN risk<0.15 THEN 'Pipeline health is strong with minimal at-risk deals. Maintain current engagement levels.' END,
  CASE WHEN delta>5 THEN 'Won deals average ' || printf('%.0f',delta) || ' more activities than lost deals. Ensure adequate engagement on all opportunities.' END,
  CASE top_loss_reason WHEN 'Price' THEN 'Price is the top loss reason. Review discounting authority and value messaging.' WHEN 'Competitor' THEN 'Competitive losses are high. Consider competitive battle card refresh and win-back programs.' END], lambda v: v IS NOT NULL) AS ins,
 list_filter([CASE WHEN at_risk_reps>0 THEN 'Schedule 1:1 coaching sessions with ' || at_risk_reps || ' at-risk reps to develop deal-specific action plans.' END,
  CASE WHEN hygiene_score<70 THEN 'Implement weekly pipeline hygiene reviews. Require close date and next step updates for all active deals.' END,
  CASE WHEN win_rate<0.35 THEN 'Win rate below target. Review qualification criteria and implement MEDDIC framework adoption.' END,
  CASE WHEN at_risk_pipeline>2000000 THEN '$' || printf('%.1f',at_risk_pipeline/1000000) || 'M at risk. Launch deal review cadence for all opportunities over $100K in late stages.' END], lambda v: v IS NOT NULL) AS rec FROM x),
z AS (SELECT * REPLACE (CASE WHEN len(rec)=0 THEN ['Maintain current processes. Focus on scaling best practices from top performers.'] ELSE rec END AS rec) FROM y)
SELECT * EXCLUDE (risk, delta, ins, rec), {L("overall_health_score", ">=", GR, "F")} AS health_grade, {", ".join(f"coalesce(ins[{i}],'') AS insight_{i}, coalesce(rec[{i}],'') AS recommendation_{i}" for i in (1, 2, 3))} FROM z
""")

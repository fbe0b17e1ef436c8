from oracles import CORR, A, L, M, N, QUARTER_AS_OF, R, RD, S, oracle

ORDER = M("stage_name", {"Prospecting": 1, "Discovery": 2, "Solution Design": 3, "Proposal": 4, "Negotiation": 5, "Verbal Commit": 6}, 0)
IN_Q = "close_date BETWEEN DATE '2001-10-01' AND DATE '2001-12-31'"


def features(where, point_in_time=False):
    # point in time: owner, account and segment history of deals closed before each deal's own close date
    prior = """o AS (SELECT d.opportunity_id, avg(h.is_won::INT) AS owr, {A} AS oad FROM d JOIN win_loss_details h ON h.owner_id = d.owner_id AND h.close_date < d.close_date GROUP BY 1),
a AS (SELECT d.opportunity_id, {W} AS w, {L} AS l FROM d JOIN win_loss_details h ON h.account_id = d.account_id AND h.close_date < d.close_date GROUP BY 1),
s AS (SELECT d.opportunity_id, avg(h.is_won::INT) AS swr FROM d JOIN win_loss_details h ON h.segment = d.segment AND h.close_date < d.close_date GROUP BY 1),""".format(A=A("h.amount"), W=N("h.is_won"), L=N("NOT h.is_won"))
    whole = f"""o AS (SELECT owner_id, avg(is_won::INT) AS owr, {A("amount")} AS oad FROM win_loss_details GROUP BY 1), a AS (SELECT account_id, {N("is_won")} AS w, {N("NOT is_won")} AS l FROM win_loss_details GROUP BY 1),
s AS (SELECT segment, avg(is_won::INT) AS swr FROM win_loss_details GROUP BY 1),"""
    joins = "LEFT JOIN o USING (opportunity_id) LEFT JOIN a USING (opportunity_id) LEFT JOIN s USING (opportunity_id)" if point_in_time else "LEFT JOIN o USING (owner_id) LEFT JOIN a USING (account_id) LEFT JOIN s USING (segment)"
    return f"""
WITH d AS (SELECT * FROM opportunities WHERE {where}),
t AS (SELECT opportunity_id, count(*) AS total_activities, {N("activity_date >= $AS_OF - 7")} AS activities_last_7d, {N("activity_date >= $AS_OF - 14")} AS activities_last_14d, ($AS_OF - max(activity_date))::INT AS dsl,
 {N("activity_type='Meeting'")} AS meetings_count, {N("activity_type='Email'")} AS emails_count, {N("activity_type='Call'")} AS calls_count, count(DISTINCT contact_id) AS people FROM activities GROUP BY 1),
{prior if point_in_time else whole}
j AS (SELECT d.*, coalesce(total_activities,0) AS total_activities, coalesce(activities_last_7d,0) AS activities_last_7d, coalesce(activities_last_14d,0) AS activities_last_14d, coalesce(meetings_count,0) AS meetings_count, coalesce(emails_count,0) AS emails_count,
 coalesce(calls_count,0) AS calls_count, coalesce(dsl,999) AS days_since_last_activity, {R("coalesce(activities_last_7d,0)", "coalesce(activities_last_14d,0)", empty=0)} AS activity_momentum, coalesce(least(people/3.0,1.0),0) AS multi_thread_score,
 coalesce(owr,0.25) AS owner_win_rate, coalesce(oad,50000) AS owner_avg_deal_size, coalesce(w,0) AS account_previous_wins, coalesce(l,0) AS account_previous_losses, coalesce(swr,0.25) AS segment_win_rate, coalesce(expected_days,14) AS norm
 FROM d LEFT JOIN t USING (opportunity_id) {joins} LEFT JOIN stage_benchmarks b USING (stage_name))
SELECT opportunity_id, opportunity_name, account_id, owner_id, stage_name, amount, close_date, ($AS_OF-created_date)::INT AS deal_age_days, {ORDER} AS stage_order, days_in_current_stage AS stage_tenure_days, round(ln(1+amount),6) AS amount_log,
 amount/(SELECT {A("amount")} FROM d) AS amount_vs_avg, total_activities, activities_last_7d, activities_last_14d, meetings_count, emails_count, calls_count, days_since_last_activity, activity_momentum,
 least(meetings_count/3.0,1.0)*0.4 + least(total_activities/10.0,1.0)*0.3 + multi_thread_score*0.3 AS engagement_score, multi_thread_score, owner_win_rate, owner_avg_deal_size, account_previous_wins, account_previous_losses, segment_win_rate,
 days_in_current_stage/norm AS stage_velocity_vs_benchmark, (close_date-$AS_OF)::INT AS days_to_close, CASE WHEN month(close_date) IN (3,6,9,12) AND day(close_date)>=28 THEN 1.0 WHEN month(close_date) IN (3,6,9,12) THEN 0.5 ELSE 0.0 END AS quarter_end_proximity FROM j
"""


oracle("deal_features", features("NOT is_closed"))
oracle("closed_features", features("is_closed AND close_date >= $AS_OF - 30", point_in_time=True))
DEF = {"stage_order": 0.15, "engagement_score": 0.12, "activity_momentum": 0.1, "owner_win_rate": 0.1, "meetings_count": 0.08, "multi_thread_score": 0.08, "account_previous_wins": 0.07, "days_since_last_activity": -0.08, "stage_velocity_vs_benchmark": -0.06}
oracle("model_weights", f"""
WITH x AS (SELECT count(*) AS n, round({CORR("is_won::INT", "coalesce(total_activities,0)", 0, 0)},6) AS r1, round({CORR("is_won::INT", "coalesce(meetings,0)", 0, 0)},6) AS r2, round({CORR("is_won::INT", "amount", 0, 2)},6) AS r3 FROM win_loss_details)
SELECT feature, weight::DOUBLE AS weight, $AS_OF AS trained_at, CASE WHEN n>=100 THEN n ELSE 0 END AS training_samples, CASE WHEN n>=100 THEN 'v20011231' ELSE 'default' END AS model_version FROM (
SELECT n, 'total_activities' AS feature, r1*0.1 AS weight FROM x WHERE n>=100 AND r1 IS NOT NULL UNION ALL SELECT n, 'meetings_count', r2*0.1 FROM x WHERE n>=100 AND r2 IS NOT NULL UNION ALL SELECT n, 'amount', r3*0.1 FROM x WHERE n>=100 AND r3 IS NOT NULL
{" ".join(f"UNION ALL SELECT n, '{f}', {w} FROM x" + (" WHERE n<100" if f == "meetings_count" else "") for f, w in DEF.items())})
""")


def scores(src):
    w = lambda f: f"coalesce((SELECT max(weight) FROM model_weights WHERE feature='{f}'), {DEF[f]})"
    return f"""
WITH p AS (SELECT *, round(greatest(least((stage_order/6.0*{w("stage_order")} + engagement_score*{w("engagement_score")} + activity_momentum*{w("activity_momentum")} + owner_win_rate*{w("owner_win_rate")} + least(meetings_count/5.0,1.0)*{w("meetings_count")}
 + multi_thread_score*{w("multi_thread_score")} + least(account_previous_wins/3.0,1.0)*{w("account_previous_wins")} + greatest(1.0-days_since_last_activity/30.0,0.0)*0.10 + greatest(1.0-(stage_velocity_vs_benchmark-1.0)/2.0,0.0)*0.10)*1.2+0.1,0.95),0.05),6) AS win_probability FROM {src})
SELECT opportunity_id, opportunity_name, account_id, owner_id, stage_name, amount, close_date, win_probability, {L("win_probability", ">=", [(0.7, "High"), (0.4, "Medium")], "Low")} AS score_band, {L("total_activities", ">=", [(5, "high"), (2, "medium")], "low")} AS score_confidence,
 list_filter([CASE WHEN days_since_last_activity>14 THEN 'No recent activity' END, CASE WHEN stage_velocity_vs_benchmark>1.5 THEN 'Slow stage progression' END, CASE WHEN meetings_count=0 THEN 'No meetings scheduled' END, CASE WHEN multi_thread_score<0.3 THEN 'Single-threaded deal' END,
 CASE WHEN engagement_score<0.3 THEN 'Low engagement' END], lambda v: v IS NOT NULL) AS risk_factors, engagement_score, activity_momentum, $AS_OF AS scored_at FROM p
"""


oracle("deal_scores", scores("deal_features"))
oracle("closed_deal_scores", scores("closed_features"))
oracle("model_performance", f"""
WITH j AS (SELECT win_probability, win_probability>=0.5 AS said, is_won FROM closed_deal_scores JOIN (SELECT opportunity_id, is_won FROM opportunities WHERE is_closed AND close_date >= $AS_OF - 30) o USING (opportunity_id)),
m AS (SELECT count(*) AS sample_size, {N("said=is_won")} AS hit, {N("said AND is_won")} AS tp, {N("said AND NOT is_won")} AS fp, {N("NOT said AND is_won")} AS fn, {A("win_probability", None, 6)} AS avg_predicted_prob, avg(is_won::INT) AS actual_win_rate FROM j),
q AS (SELECT *, hit/sample_size AS accuracy, {R("tp", "tp+fp", empty=0)} AS precision, {R("tp", "tp+fn", empty=0)} AS recall FROM m WHERE sample_size>0)
SELECT $AS_OF AS evaluation_date, sample_size, accuracy, precision, recall, {R("2*(precision*recall)", "precision+recall", empty=0)} AS f1_score, avg_predicted_prob, actual_win_rate FROM q
""")

oracle("churn_features", f"""
WITH u AS (SELECT account_id, avg(daily_active_users) FILTER (WHERE usage_date>=$AS_OF-30) AS avg_dau_30d, avg(total_events) FILTER (WHERE usage_date>=$AS_OF-30) AS avg_events_30d, {A("engagement_score", "usage_date>=$AS_OF-30", 1)} AS avg_engagement_30d,
 {N("usage_date>=$AS_OF-30")} AS active_days_30d, max(usage_date) FILTER (WHERE usage_date>=$AS_OF-30) AS last_usage_date, avg(daily_active_users) AS avg_dau_90d, {A("engagement_score", None, 1)} AS avg_engagement_90d FROM product_usage WHERE usage_date>=$AS_OF-90 GROUP BY 1),
t AS (SELECT account_id, {N("created_date>=$AS_OF-30")} AS tickets_30d, {N("created_date>=$AS_OF-30 AND severity='Critical'")} AS critical_tickets_30d, {N("created_date>=$AS_OF-30 AND severity='High'")} AS high_tickets_30d, avg(satisfaction_rating) FILTER (WHERE created_date>=$AS_OF-30) AS avg_csat_30d,
 {A("resolution_hours", "created_date>=$AS_OF-30", 1)} AS avg_resolution_time_30d, count(*) AS tickets_90d, avg(satisfaction_rating) AS avg_csat_90d FROM support_tickets WHERE created_date>=$AS_OF-90 GROUP BY 1),
a AS (SELECT account_id, count(*) AS activities_30d, {N("activity_type='Meeting'")} AS meetings_30d, count(DISTINCT contact_id) AS contacts_engaged_30d, max(activity_date) AS lt FROM activities WHERE activity_date>=$AS_OF-30 GROUP BY 1),
g AS (SELECT account_id, {S("amount", "is_won")} AS ew, {S("amount", "NOT is_won")} AS el, {N("stage_name='Closed Lost'")} AS lo FROM opportunities WHERE created_date>=$AS_OF-90 AND deal_type IN ('Expansion','Renewal','Upsell') GROUP BY 1)
SELECT c.account_id, account_name, segment, industry, owner_id, annual_revenue AS arr, ($AS_OF-created_date)::INT AS tenure_days, ($AS_OF-created_date)/30 AS tenure_months,
 coalesce(avg_dau_30d,0) AS avg_dau_30d, avg_events_30d, coalesce(avg_engagement_30d,0) AS avg_engagement_30d, active_days_30d, last_usage_date, avg_dau_90d, avg_engagement_90d,
 coalesce(CASE WHEN avg_engagement_90d>0 THEN (avg_engagement_30d-avg_engagement_90d)/avg_engagement_90d ELSE 0 END,0)::DOUBLE AS engagement_trend, coalesce(CASE WHEN avg_dau_90d>0 THEN (avg_dau_30d-avg_dau_90d)/avg_dau_90d ELSE 0 END,0)::DOUBLE AS dau_trend,
 coalesce(($AS_OF-last_usage_date)::INT,30) AS days_since_last_usage, coalesce(active_days_30d/30.0,0) AS usage_frequency, coalesce(tickets_30d,0) AS tickets_30d, coalesce(critical_tickets_30d,0) AS critical_tickets_30d, high_tickets_30d, coalesce(avg_csat_30d,3.0) AS avg_csat_30d,
 avg_resolution_time_30d, tickets_90d, avg_csat_90d, coalesce((tickets_30d*3-tickets_90d)/tickets_90d,0)::DOUBLE AS ticket_trend, coalesce(CASE WHEN avg_csat_90d>0 THEN (coalesce(avg_csat_30d,3.0)-avg_csat_90d)/avg_csat_90d ELSE 0 END,0)::DOUBLE AS csat_trend,
 coalesce(activities_30d,0) AS activities_30d, coalesce(meetings_30d,0) AS meetings_30d, coalesce(contacts_engaged_30d,0) AS contacts_engaged_30d, coalesce(ew,0) AS expansion_won_90d, coalesce(el,0) AS expansion_lost_90d, coalesce(lo,0) AS lost_opps_90d,
 coalesce(($AS_OF-lt)::INT,999) AS days_since_contact, {R("coalesce(ew,0)-coalesce(el,0)", "annual_revenue", empty=0)} AS net_expansion_rate
FROM (SELECT * FROM accounts WHERE current_arr>0) c LEFT JOIN (SELECT * FROM u WHERE active_days_30d>0) u USING (account_id) LEFT JOIN (SELECT * FROM t WHERE tickets_30d>0) t USING (account_id) LEFT JOIN a USING (account_id) LEFT JOIN g USING (account_id)
""")
FL = [("engagement_risk", 0.3, "Declining engagement"), ("usage_risk", 0.3, "Declining usage"), ("frequency_risk", 0.5, "Infrequent usage"), ("contact_risk", 0.5, "No recent contact"), ("inactivity_risk", 0.5, "Product inactivity"), ("support_risk", 0.3, "Critical support issues"), ("satisfaction_risk", 0.2, "Declining satisfaction"), ("expansion_risk", 0.1, "Contract contraction")]
oracle("churn_scores", f"""
WITH r AS (SELECT *, greatest(0.0,-engagement_trend) AS engagement_risk, greatest(0.0,-dau_trend) AS usage_risk, greatest(0.0,1.0-usage_frequency) AS frequency_risk, least(1.0,greatest(0.0,ticket_trend)) AS ticket_risk, greatest(0.0,-csat_trend) AS satisfaction_risk,
 least(days_since_contact/60.0,1.0) AS contact_risk, least(days_since_last_usage/30.0,1.0) AS inactivity_risk, least(critical_tickets_30d/3.0,1.0) AS support_risk, greatest(0.0,-net_expansion_rate) AS expansion_risk FROM churn_features),
s AS (SELECT *, round(least(greatest(engagement_risk*0.20 + usage_risk*0.15 + frequency_risk*0.15 + ticket_risk*0.10 + satisfaction_risk*0.10 + contact_risk*0.10 + inactivity_risk*0.10 + support_risk*0.05 + expansion_risk*0.05, 0.01), 0.99),6) AS churn_probability FROM r)
SELECT account_id, account_name, segment, owner_id, arr AS annual_revenue, tenure_months, churn_probability, {L("churn_probability", ">=", [(0.7, "Critical"), (0.4, "High"), (0.2, "Medium")], "Low")} AS churn_risk_tier,
 list_filter([{", ".join(f"CASE WHEN {n}>{b} THEN '{t}' END" for n, b, t in FL)}], lambda v: v IS NOT NULL) AS risk_factors,
 CASE WHEN churn_probability>=0.7 THEN 'Executive escalation - schedule QBR immediately' WHEN contact_risk>0.5 THEN 'Schedule customer check-in call' WHEN inactivity_risk>0.5 THEN 'Trigger product adoption campaign' WHEN support_risk>0.3 THEN 'Escalate open support tickets'
  WHEN satisfaction_risk>0.2 THEN 'Request customer feedback' ELSE 'Monitor - no immediate action required' END AS recommended_action, engagement_risk, usage_risk, contact_risk, support_risk, $AS_OF AS scored_at FROM s
""")
oracle("churn_cohorts", f"""
SELECT *, (critical_arr+high_arr)/total_arr AS at_risk_pct, $AS_OF AS snapshot_time FROM (SELECT *, critical_arr+high_arr+medium_arr+low_arr AS total_arr FROM (SELECT segment, {", ".join(S("annual_revenue", f"churn_risk_tier='{t}'") + f" AS {t.lower()}_arr" for t in ("Critical", "High", "Medium", "Low"))}, count(*) AS total_customers FROM churn_scores GROUP BY 1))
""")

RULES = [("quiet>14", "REACTIVATE_STALE", "85+least(quiet-14,10)", "'No activity in ' || quiet || ' days'", "rescue", "high"),
         ("met=0 AND stage_name NOT IN ('Prospecting','Closed Won','Closed Lost')", "SCHEDULE_MEETING", "80", "'No meetings recorded for this opportunity'", "engagement", "high"),
         ("coalesce(engagement_score,0)<0.3 AND amount>50000", "MULTI_THREAD", "75", "'Low engagement on high-value deal'", "strategy", "high"),
         ("month(close_date) IN (3,6,9,12) AND dleft<=14 AND stage_name IN ('Proposal','Negotiation','Verbal Commit')", "QUARTER_END_PUSH", "95", "'Quarter ending soon with deal in late stage'", "timing", "critical"),
         ("amount>100000 AND stage_name IN ('Solution Design','Proposal')", "EXECUTIVE_SPONSOR", "90", "'Large deal may benefit from executive involvement'", "strategy", "high"),
         ("dleft<0", "UPDATE_CLOSE_DATE", "60", "'Close date is ' || (-dleft) || ' days past due'", "hygiene", "low"),
         ("is_missing_next_steps", "ADD_NEXT_STEP", "65", "'No next step defined'", "hygiene", "low"),
         ("stage_name='Solution Design' AND met>=2", "SEND_PROPOSAL", "85", "'Deal ready to advance to proposal stage'", "progression", "high")]
oracle("deal_recommendations", f"""
WITH d AS (SELECT o.opportunity_id, opportunity_name, account_id, o.account_name, o.owner_id, o.amount, o.stage_name, o.close_date, contact_name, engagement_score, is_missing_next_steps, coalesce(($AS_OF-lt)::INT,999) AS quiet, (o.close_date-$AS_OF)::INT AS dleft, coalesce(m,0) AS met
 FROM (SELECT * FROM opportunities WHERE NOT is_closed) o LEFT JOIN (SELECT opportunity_id, engagement_score FROM deal_scores) s USING (opportunity_id) LEFT JOIN (SELECT opportunity_id, max(activity_date) AS lt, {N("activity_type='Meeting'")} AS m FROM activities GROUP BY 1) t USING (opportunity_id)
 LEFT JOIN (SELECT opportunity_id, is_missing_next_steps FROM pipeline_hygiene_alerts) h USING (opportunity_id) LEFT JOIN (SELECT account_id, first_name || ' ' || last_name AS contact_name FROM contacts WHERE is_primary) c USING (account_id))
{" UNION ALL ".join(f"SELECT opportunity_id, opportunity_name, account_id, account_name, owner_id, amount, stage_name, contact_name, '{a}' AS action_type, ({p})::INT AS priority, {t} AS reason, '{c}' AS category, '{i}' AS impact, $AS_OF AS generated_at FROM d WHERE {w}" for w, a, p, t, c, i in RULES)}
""")
oracle("rep_recommendations", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY priority DESC, amount DESC, opportunity_id, action_type) AS rk FROM deal_recommendations),
o AS (SELECT owner_id, count(*) AS total_actions, {N("impact='critical'")} AS critical_actions, {N("impact='high'")} AS high_priority_actions, {S("amount")} AS total_amount_at_stake, string_agg(opportunity_name || ': ' || action_type || ': ' || reason, '; ' ORDER BY rk) AS top_actions FROM r WHERE rk<=5 GROUP BY 1),
c AS (SELECT owner_id, count(*) AS at_risk_customers, {S("annual_revenue")} AS arr_at_risk FROM churn_scores WHERE churn_risk_tier IN ('Critical','High') GROUP BY 1)
SELECT *, coalesce(critical_actions,0)*3+coalesce(high_priority_actions,0)*2+coalesce(at_risk_customers,0)*2 AS urgency_score, CASE WHEN critical_actions>0 THEN 'Focus on ' || critical_actions || ' critical deal actions' WHEN at_risk_customers>0 THEN 'Address ' || at_risk_customers || ' at-risk customer relationships'
 WHEN total_actions>0 THEN 'Complete ' || total_actions || ' recommended actions' ELSE 'No urgent actions - maintain current activities' END AS summary, $AS_OF AS generated_at
FROM o LEFT JOIN c USING (owner_id) LEFT JOIN (SELECT rep_id AS owner_id, rep_name, ytd_attainment AS quota_attainment FROM coaching_rep_performance) p USING (owner_id) LEFT JOIN (SELECT rep_id AS owner_id, pipeline_coverage FROM sales_reps) s USING (owner_id)
""")
oracle("rep_churn_actions", "SELECT owner_id, account_id, account_name, churn_probability, recommended_action FROM churn_scores WHERE churn_risk_tier IN ('Critical','High')")
oracle("account_recommendations", f"""
SELECT account_id, account_name, segment, owner_id, open_opportunities, open_pipeline, furthest_stage, churn_risk_tier, churn_probability, risk_factors, pending_actions,
 CASE WHEN churn_risk_tier='Critical' THEN 'URGENT: Schedule executive business review' WHEN churn_risk_tier='High' THEN 'Schedule customer success check-in' WHEN open_opportunities=0 AND segment='Enterprise' THEN 'Identify expansion opportunities'
  WHEN open_pipeline>500000 THEN 'Assign executive sponsor for strategic account' WHEN pending_actions>3 THEN 'Prioritize and consolidate pending actions' ELSE 'Maintain regular engagement cadence' END AS strategic_recommendation,
 {RD("coalesce(churn_probability,0)*30 + least(coalesce(open_pipeline,0)/100000,50.0) + coalesce(max_priority,0)*0.2", 6)} AS priority_score, $AS_OF AS generated_at
FROM (SELECT account_id, account_name, segment, owner_id FROM accounts) LEFT JOIN (SELECT account_id, count(*) AS open_opportunities, {S("amount")} AS open_pipeline, arg_max(stage_name, {ORDER}) AS furthest_stage FROM opportunities WHERE NOT is_closed GROUP BY 1) USING (account_id)
 LEFT JOIN (SELECT account_id, churn_probability, churn_risk_tier, risk_factors FROM churn_scores) USING (account_id) LEFT JOIN (SELECT account_id, count(*) AS pending_actions, max(priority) AS max_priority FROM deal_recommendations GROUP BY 1) USING (account_id)
""")

from quotaloom.operators.models import ACTION_TEXT, MANAGER_TEXT  # noqa: E402  (fixed texts only)

oracle("dashboard_next_best_actions", f"""
WITH d AS (SELECT h.*, r.rep_name, r.rr, r.rs, CASE WHEN is_hero_deal AND health_category='Critical' THEN 'EXEC_SPONSOR_OUTREACH' WHEN days_since_activity>7 THEN 'REENGAGE_CONTACTS' WHEN stakeholder_count<2 THEN 'MULTI_THREAD_DEAL' WHEN is_competitive THEN 'COMPETITIVE_STRATEGY_REVIEW' ELSE 'MANAGER_DEAL_REVIEW' END AS action_type,
 amount*CASE health_category WHEN 'Critical' THEN 0.6 WHEN 'At Risk' THEN 0.4 WHEN 'Monitor' THEN 0.2 ELSE 0.1 END AS impact FROM deal_health h LEFT JOIN (SELECT rep_id, rep_name, region AS rr, segment AS rs FROM sales_reps) r ON r.rep_id=h.owner_id
 WHERE needs_attention OR (is_hero_deal AND health_category IN ('At Risk','Critical')))
SELECT 'ACT-' || opportunity_id AS action_id, opportunity_id, account_id, account_name, opportunity_name, CASE WHEN rep_name IS NOT NULL THEN owner_id END AS rep_id, rep_name AS owner_name, rr AS region, rs AS segment, action_type,
 CASE WHEN is_hero_deal THEN 'Save Hero Deal: ' WHEN health_category='Critical' THEN 'Critical Deal Intervention: ' WHEN health_category='At Risk' THEN 'At Risk Deal: ' ELSE 'Follow Up: ' END || account_name AS action_title, {M("action_type", ACTION_TEXT, MANAGER_TEXT)} AS action_description,
 CASE health_category WHEN 'Critical' THEN 100 WHEN 'At Risk' THEN 80 WHEN 'Monitor' THEN 60 ELSE 40 END + CASE WHEN is_hero_deal THEN 10 ELSE 0 END + CASE WHEN amount>=500000 THEN 5 ELSE 0 END AS priority,
 'Protect approximately $' || format('{{:,}}', round_even(impact,0)::BIGINT) || ' in at-risk pipeline.' AS expected_impact, round(impact,0) AS expected_impact_amount, CASE health_category WHEN 'Critical' THEN 0.8 WHEN 'At Risk' THEN 0.75 WHEN 'Monitor' THEN 0.6 ELSE 0.5 END AS confidence,
 $AS_OF + CASE health_category WHEN 'Critical' THEN 2 WHEN 'At Risk' THEN 5 ELSE 7 END AS due_date, $AS_OF AS created_at, 'Open' AS status, 'HealthModel' AS source,
 {M("action_type", {"EXEC_SPONSOR_OUTREACH": "Exec Save Play", "MULTI_THREAD_DEAL": "Multi-threading Play", "REENGAGE_CONTACTS": "Re-engagement Play"}, "Manager Review Play")} AS playbook, amount, health_score, health_category, risk_level, needs_attention FROM d
""")
oracle("coaching_actions", "SELECT rep_id, opportunity_id, account_name, action_type, action_description, priority, expected_impact, due_date FROM dashboard_next_best_actions")
oracle("priority_actions", f"""
WITH s AS (SELECT d.*, h.* EXCLUDE (opportunity_id), (100-health_score)*2 + (100-coalesce(hygiene_score,100))*1.5 + least(days_since_activity*5,50) + {L("amount", ">=", [(1000000, 30), (500000, 20), (200000, 10)], 5)} + CASE WHEN close_date-$AS_OF<=15 THEN 25 WHEN close_date-$AS_OF<=30 THEN 15 ELSE 5 END
 + {M("health_category", {"Critical": 30, "At Risk": 15}, 0)} + {M("alert_severity", {"CRITICAL": 40, "HIGH": 25, "MEDIUM": 10}, 0)} AS priority_score
 FROM deal_health d LEFT JOIN (SELECT opportunity_id, hygiene_score, hygiene_category, violation_count, primary_alert, alert_severity, recommended_action, is_stale_close_date, is_single_threaded, is_missing_next_steps, is_gone_dark, is_missing_champion FROM pipeline_hygiene_alerts) h USING (opportunity_id) WHERE NOT is_closed),
r AS (SELECT *, (row_number() OVER (PARTITION BY owner_id ORDER BY priority_score DESC NULLS LAST, opportunity_id))::INT AS priority_rank FROM s),
a AS (SELECT *, CASE WHEN is_gone_dark THEN 'call' WHEN is_stale_close_date THEN 'update' WHEN is_missing_champion OR is_single_threaded THEN 'meeting' WHEN is_missing_next_steps THEN 'task' WHEN days_since_activity>=7 OR health_category IN ('Critical','At Risk') OR stage_name='Proposal' THEN 'call' WHEN stakeholder_count<2 THEN 'meeting' ELSE 'email' END AS action_type FROM r WHERE priority_rank<=10)
SELECT opportunity_id || '-action' AS action_id, owner_id AS rep_id, opportunity_id, account_name, opportunity_name, 'Primary Contact' AS contact_name, 'Champion' AS contact_role, action_type,
 CASE WHEN alert_severity IN ('CRITICAL','HIGH') THEN recommended_action WHEN days_since_activity>=10 THEN 'Re-engage - ' || days_since_activity || ' days since last contact' WHEN days_since_activity>=7 THEN 'Follow up - deal going quiet' WHEN health_category='Critical' THEN 'Urgent attention - deal at critical health'
  WHEN stakeholder_count<2 THEN 'Expand contacts - currently single-threaded' WHEN stage_name='Proposal' THEN 'Follow up on pricing proposal' WHEN is_competitive THEN 'Competitive deal - maintain momentum' ELSE 'Regular check-in' END AS action_reason,
 priority_score, priority_rank, '2:00 PM' AS best_time_start, '4:00 PM' AS best_time_end, CASE WHEN alert_severity='CRITICAL' OR priority_score>=150 THEN 'today' WHEN alert_severity='HIGH' OR priority_score>=100 THEN 'this_week' ELSE 'soon' END AS urgency, amount AS deal_amount, health_score AS deal_health, days_since_activity,
 coalesce(hygiene_score,100) AS hygiene_score, coalesce(hygiene_category,'Clean') AS hygiene_category, coalesce(violation_count,0) AS violation_count, coalesce(primary_alert,'NONE') AS primary_alert, coalesce(alert_severity,'NONE') AS alert_severity,
 CASE WHEN alert_severity='CRITICAL' THEN 'Critical hygiene issue - immediate action required' WHEN alert_severity='HIGH' THEN 'High-priority hygiene violation' WHEN days_since_activity>=10 THEN 'High risk of deal going cold' WHEN health_category='Critical' THEN 'Deal may slip quarter without intervention' ELSE 'Maintain deal momentum' END AS risk_if_delayed,
 {M("action_type", {"call": "phone", "email": "mail", "meeting": "calendar", "update": "edit", "task": "check-square"}, "clipboard")} AS action_icon, 'Today 2-4pm' AS time_display FROM a
""")
oracle("dashboard_kpis", f"""
SELECT * EXCLUDE (pct), gap_to_target/13000000.0 AS gap_pct, CASE WHEN gap_to_target/13000000.0<=0 THEN 'Low' WHEN gap_to_target/13000000.0<=0.1 THEN 'Medium' WHEN gap_to_target/13000000.0<=0.2 THEN 'High' ELSE 'Critical' END AS risk_level
FROM (SELECT *, $AS_OF AS snapshot_date, {QUARTER_AS_OF} AS quarter, 'All' AS team_filter, 13000000.0 AS quarter_target, CASE WHEN pct>1 THEN pct/100 ELSE pct END AS ai_forecast_confidence, 13000000.0-ai_forecast AS gap_to_target, {R("open_pipeline", "13000000.0-closed_won_amount", empty=0)} AS coverage_ratio
FROM (SELECT {S("amount", "is_won")} AS closed_won_amount, {S("amount", "NOT is_closed")} AS open_pipeline FROM opportunities WHERE {IN_Q}),
(SELECT max(weighted_amount) FILTER (WHERE category='TOTAL FORECAST') AS ai_forecast, max(confidence_pct) FILTER (WHERE category='TOTAL FORECAST') AS pct, max(amount) FILTER (WHERE category='Commit') AS commit_amount, max(weighted_amount) FILTER (WHERE category='Commit') AS commit_weighted FROM forecast_confidence))
""")

oracle("impact_tracker", f"""
SELECT *, {R("actions_with_decision", "actions_created", empty=0)} AS decision_rate, {R("total_realized_impact_amount", "total_expected_impact_amount", empty=0)} AS realized_vs_expected_ratio
FROM (SELECT coalesce(quarter,'Unspecified') AS quarter, region, segment, count(DISTINCT a.action_id) AS actions_created, {N("decision_date IS NOT NULL")} AS actions_with_decision, count(DISTINCT a.action_id) FILTER (WHERE decision_date IS NULL) AS actions_without_decision, avg(decision_date-created_at) AS avg_time_to_decision_days,
 {S("a.expected_impact_amount")} AS total_expected_impact_amount, {S("realized_impact_amount", None, 4)} AS total_realized_impact_amount, {N("result='Won'")} AS deals_won, {N("result='Lost'")} AS deals_lost, {N("result='Slip'")} AS deals_slipped FROM dashboard_next_best_actions a LEFT JOIN sales_interventions i ON i.action_id=a.action_id GROUP BY 1,2,3)
""")
oracle("intervention_effectiveness", f"""
SELECT *, avg_post_health_score-avg_pre_health_score AS health_delta, {R("deals_won", "deals_impacted", empty=0)} AS win_rate, {R("total_realized_impact_amount", "total_expected_impact_amount", empty=0)} AS realized_vs_expected_ratio
FROM (SELECT coalesce(playbook,'No Playbook') AS playbook, coalesce(decision_type,'Unspecified') AS decision_type, coalesce(actor_role,'Unknown') AS actor_role, coalesce(quarter,'Unspecified') AS quarter, count(*) AS decisions, count(DISTINCT i.opportunity_id) AS deals_impacted,
 {N("result='Won'")} AS deals_won, {N("result='Lost'")} AS deals_lost, {N("result='Slip'")} AS deals_slipped, {N("result='Open'")} AS deals_still_open, avg(pre_health_score) AS avg_pre_health_score, avg(post_health_score) AS avg_post_health_score, {A("i.expected_impact_amount", None, 4)} AS avg_expected_impact_amount,
 {S("i.expected_impact_amount", None, 4)} AS total_expected_impact_amount, {A("realized_impact_amount", None, 4)} AS avg_realized_impact_amount, {S("realized_impact_amount", None, 4)} AS total_realized_impact_amount FROM sales_interventions i LEFT JOIN (SELECT action_id, playbook FROM dashboard_next_best_actions) p USING (action_id) GROUP BY 1,2,3,4)
""")
oracle("alerts_summary", f"SELECT count(*) AS total_active, {', '.join(N(f'''alert_severity='{s.upper()}' ''') + f' AS {s}_count' for s in ('critical', 'high', 'medium', 'low'))}, 0 AS acknowledged_count, 0 AS resolved_today, 4.5 AS avg_resolution_time, $AS_OF AS snapshot_date FROM pipeline_hygiene_alerts")
_al = "$AS_OF AS created_at, 'Active' AS status, NULL::VARCHAR AS acknowledged_by, NULL::DATE AS acknowledged_at, NULL::DATE AS resolved_at, 'Opportunity' AS related_object_type, opportunity_id AS related_object_id, opportunity_name AS related_object_name, '/deals/' || opportunity_id AS action_url, owner_name AS assignee"
oracle("alerts_active", f"""
SELECT 'HYG-' || opportunity_id AS alert_id, alert_severity || ' Hygiene Alert: ' || primary_alert AS title, opportunity_name || ' (' || account_name || ') - ' || recommended_action AS description, alert_severity AS severity, 'Pipeline Hygiene' AS category, 'Hygiene Monitor' AS source, {_al} FROM pipeline_hygiene_alerts WHERE alert_severity IN ('CRITICAL','HIGH','MEDIUM')
UNION ALL SELECT 'HEALTH-' || opportunity_id, 'Critical Deal Health: ' || opportunity_name, 'Health score dropped to ' || health_score::INT || ' - immediate attention required', 'CRITICAL', 'Deal Health', 'Health Monitor', {_al} FROM deal_health WHERE health_category='Critical'
""")
from quotaloom.operators.loop import ALERT_RULES, FIELD_CHECKS  # noqa: E402  (fixed values only)

oracle("alert_rules", " UNION ALL ".join(f"SELECT '{i}' AS rule_id, '{n}' AS name, '{c}' AS category, '{s}' AS severity, '{w}' AS condition, {t}::DOUBLE AS threshold, '{ch}' AS notification_channels, true AS enabled, (SELECT count(*) FROM deal_health WHERE {w.replace('evaluated_on', '$AS_OF')}) AS trigger_count" for i, n, c, s, w, t, ch in ALERT_RULES))
oracle("data_quality_summary", f"""
SELECT * EXCLUDE (n, z), round(completeness_score*0.4+validity_score*0.35+freshness_score*0.25,2) AS overall_score FROM (SELECT *, round(1-z/(n*4),3) AS completeness_score, round(1-critical_issues/n,3) AS validity_score, 0.95 AS freshness_score, n+(SELECT count(*) FROM accounts)+(SELECT count(*) FROM sales_reps) AS total_records, z+critical_issues AS issue_count,
 'Healthy' AS sync_status, 'improving' AS trend FROM (SELECT count(*) AS n, {" + ".join(N(f"{f} IS NULL") for f in ("opportunity_name", "amount", "close_date", "owner_id"))} AS z, {N("amount<0 OR amount>10000000 OR discount_percent<0 OR discount_percent>100")} AS critical_issues FROM opportunities))
""")
_dq = lambda m, c, o, f, t: f"""SELECT '{m}' AS metric_name, '{c}' AS category, '{o}' AS object_type, sc AS current_score, {t} AS target_score, {f"CASE WHEN abs(sc-{t})<0.05 THEN 'stable' ELSE 'declining' END" if o == "Opportunity" else "'stable'"} AS trend, z AS issue_count, z || ' records missing {f}' AS sample_issues,
 {f"CASE WHEN z>0 THEN 'Run data enrichment for {f}' ELSE 'No action needed' END" if o == "Opportunity" else f"'Enrich {f} from external source'"} AS remediation_action, 'Data Ops' AS owner FROM (SELECT {N(f"{f} IS NULL")} AS z, round(1-{N(f"{f} IS NULL")}/count(*),2) AS sc FROM {"opportunities" if o == "Opportunity" else "accounts"})"""  # noqa: E731
oracle("data_quality_metrics", " UNION ALL ".join(_dq(*c) for c in FIELD_CHECKS))

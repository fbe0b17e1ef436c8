from oracles import A, L, M, N, R, RD, S, oracle

T = "ts - INTERVAL 8058 DAY"
END = "($AS_OF + 1)::TIMESTAMP"
oracle("tenant_settings", "SELECT c_custkey AS customer_id, c_name AS customer_name, CASE c_custkey%3 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' ELSE 'enterprise' END AS tier, CASE c_custkey%3 WHEN 0 THEN 10 WHEN 1 THEN 50 ELSE 500 END AS max_users, $AS_OF - ((c_custkey*7)%400)::INT AS onboarded_at, c_custkey%2=0 AS alerts_enabled FROM customer")
oracle("build_log", f"""SELECT user_id AS customer_id, CASE event_id%8 WHEN 0 THEN '/Staging/opportunities' WHEN 1 THEN '/Staging/activities' WHEN 2 THEN '/Enriched/deal_health_scores' WHEN 3 THEN '/Enriched/accounts' WHEN 4 THEN '/Analytics/pipeline_summary' WHEN 5 THEN '/Analytics/forecast_methods' WHEN 6 THEN '/Dashboard/kpis' ELSE '/Monitoring/usage' END AS dataset_path,
 event_id AS build_id, {T} AS build_timestamp, CASE WHEN event_type='error' AND value>60 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, value AS duration_seconds, event_id%1000 AS record_count, CASE WHEN event_type='error' AND value>60 THEN 'Task failed' END AS error_message FROM events""")
oracle("feature_events", f"""SELECT user_id AS customer_id, {M("event_type", {"click": "pipeline_health_dashboard", "view": "pipeline_hygiene_dashboard", "purchase": "forecasting_dashboard", "signup": "coaching"}, "support")} AS feature_name, {T} AS usage_timestamp FROM events""")
oracle("sync_log", f"""SELECT user_id AS customer_id, {M("event_type", {"click": "crm", "view": "support", "purchase": "marketing", "signup": "product"}, "crm")} AS sync_type, {M("event_id%6", {0: "crm_a", 1: "crm_b", 2: "helpdesk", 3: "warehouse", 4: "chat"}, "product")} AS source_system,
 CASE WHEN event_type='error' AND value>80 THEN 'failed' WHEN event_id%17=0 THEN 'warning' ELSE 'success' END AS status, {T} AS last_sync_at, event_id%2000 AS records_synced, event_id%20 AS records_failed FROM events""")
oracle("agent_actions", f"""SELECT user_id AS customer_id, CASE WHEN event_id%9<>0 THEN 'rebuild' END AS action_type, {T} AS executed_at, CASE event_id%4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' END AS feedback, (1+event_id%5)::INT AS rating, CASE event_id%5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'success' END AS result FROM events WHERE event_type='purchase'""")
oracle("go_live", "SELECT c_custkey AS customer_id, true AS go_live_approved, $AS_OF - (c_custkey%120)::INT AS go_live_date, c_custkey%8=0 AS cs_handoff_complete, 'CS ' || (c_custkey%6) AS cs_owner FROM customer")
oracle("subscription_events", """SELECT o_custkey AS customer_id, o_orderdate::DATE AS event_date, o_orderkey AS event_seq, CASE WHEN o_orderkey%3=0 THEN 'annual' ELSE 'monthly' END AS billing_cycle, CASE o_orderkey%10 WHEN 0 THEN 'canceled' WHEN 1 THEN 'past_due' ELSE 'active' END AS subscription_status, o_orderdate::DATE AS started_at,
 date_trunc('month',o_orderdate)::DATE AS current_period_start, last_day(o_orderdate::DATE) AS current_period_end, o_orderkey%6=0 AS is_trial, CASE WHEN o_orderkey%6=0 THEN o_orderdate::DATE+14 END AS trial_ends_at, o_orderkey%9=0 AS cancel_at_period_end FROM orders""")
oracle("webhook_configs", "SELECT c_custkey AS webhook_id, c_custkey AS customer_id, 'Hook ' || c_custkey AS name, c_custkey%5<>0 AS is_active, (c_custkey%13)::INT AS failure_count FROM customer")
oracle("webhook_delivery_log", f"SELECT event_id AS delivery_id, user_id AS webhook_id, event_type, (1+event_id%6)::INT AS attempt_count, CASE event_id%8 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE 200 END AS response_code, floor(value*10)::INT AS response_time_ms, {T} AS created_at FROM events")
oracle("notification_events", f"""SELECT event_id AS notification_id, user_id AS customer_id, CASE event_id%3 WHEN 0 THEN 'alert' WHEN 1 THEN 'digest' ELSE 'nudge' END AS notification_type, CASE event_id%4 WHEN 0 THEN 'email' WHEN 1 THEN 'slack' WHEN 2 THEN 'in_app' ELSE 'webhook' END AS channel, repeat('Message ' || event_id || '. ', 1+event_id%20) AS body,
 CASE WHEN event_id%25<>0 THEN {T} END AS sent_at, CASE WHEN event_id%25<>0 AND event_id%5<>0 THEN {T} + to_seconds(floor(value)::INT) END AS delivered_at, CASE WHEN event_id%25<>0 AND event_id%5<>0 AND event_id%3=0 THEN {T} + to_minutes(floor(value)::INT) END AS read_at,
 CASE WHEN event_type='error' AND value>60 THEN 'Channel error' END AS error_message FROM events""")
oracle("user_preferences", "SELECT c_custkey AS user_id, c_custkey AS customer_id, CASE WHEN c_custkey%3<>0 THEN c_custkey%2=0 END AS email_enabled, CASE WHEN c_custkey%4<>0 THEN c_custkey%5=0 END AS slack_enabled, CASE WHEN c_custkey%5<>0 THEN c_custkey%7<>0 END AS in_app_enabled, CASE WHEN c_custkey%6<>0 THEN 'weekly' END AS digest_frequency, CASE WHEN c_custkey%2<>0 THEN 22 END AS quiet_hours_start, CASE WHEN c_custkey%2<>0 THEN 7 END AS quiet_hours_end FROM customer")

oracle("usage_daily", f"""
WITH u AS (SELECT account_id AS customer_id, activity_date AS d, 'touch' AS kind, owner_id AS who, NULL AS feature, NULL AS seconds FROM activities UNION ALL SELECT customer_id, build_timestamp::DATE, 'build', NULL, NULL, duration_seconds FROM build_log
 UNION ALL SELECT account_id, event_timestamp::DATE, 'api', NULL, NULL, NULL FROM product_events UNION ALL SELECT customer_id, usage_timestamp::DATE, 'feature', NULL, feature_name, NULL FROM feature_events),
g AS (SELECT customer_id, d AS usage_date, count(DISTINCT who) AS a, {N("kind='build'")} AS b, {S("seconds")} AS s, {N("kind='api'")} AS c, count(DISTINCT feature) AS f, {N("kind='feature'")} AS e FROM u WHERE d BETWEEN DATE '2001-12-01' AND $AS_OF GROUP BY 1,2)
SELECT t.customer_id, customer_name, tier, coalesce(n,0) AS active_opportunities, coalesce(v,0) AS total_pipeline_value, coalesce(usage_date,$AS_OF) AS usage_date, coalesce(a,0) AS active_users_today, coalesce(b,0) AS builds_today, coalesce(s,0) AS compute_seconds_today, coalesce(c,0) AS api_calls_today, coalesce(f,0) AS features_used_today,
 coalesce(e,0) AS feature_events_today, coalesce(s,0)/3600 AS compute_hours_today FROM tenant_settings t LEFT JOIN (SELECT account_id AS customer_id, count(*) AS n, {S("amount")} AS v FROM opportunities WHERE NOT is_closed GROUP BY 1) USING (customer_id) LEFT JOIN g USING (customer_id)
""")
LIM = {"users": (10, 50, 500), "opportunities": (10000, 50000, 500000), "api_calls": (0, 100000, 1000000), "compute_hours": (10, 100, 1000)}
oracle("usage_summary", f"""
WITH m AS (SELECT customer_id, tier, max(active_users_today) AS peak_active_users, avg(active_users_today) AS avg_daily_active_users, count(DISTINCT usage_date) AS active_days, max(active_opportunities) AS peak_opportunities, avg(active_opportunities) AS avg_opportunities, max(total_pipeline_value) AS peak_pipeline_value,
 sum(builds_today)::BIGINT AS total_builds, {S("compute_seconds_today")}/3600 AS total_compute_hours, sum(api_calls_today)::BIGINT AS total_api_calls, max(features_used_today) AS max_features_used, sum(feature_events_today)::BIGINT AS total_feature_events FROM usage_daily GROUP BY 1,2),
l AS (SELECT *, {", ".join(f"CASE tier WHEN 'starter' THEN {a} WHEN 'growth' THEN {b} WHEN 'enterprise' THEN {c} END AS limit_{n}" for n, (a, b, c) in LIM.items())} FROM m),
o AS (SELECT *, {R("peak_active_users", "limit_users", empty=0)} AS user_utilization, {R("peak_opportunities", "limit_opportunities", empty=0)} AS opportunity_utilization, {R("total_api_calls", "limit_api_calls", empty=0)} AS api_utilization, {R("total_compute_hours", "limit_compute_hours", empty=0)} AS compute_utilization,
 greatest(peak_active_users-limit_users,0)::BIGINT AS users_overage, greatest(peak_opportunities-limit_opportunities,0)::BIGINT AS opportunities_overage, greatest(total_api_calls-limit_api_calls,0)::BIGINT AS api_overage, greatest(total_compute_hours-limit_compute_hours,0.0) AS compute_overage FROM l)
SELECT *, users_overage>0 OR opportunities_overage>0 OR api_overage>0 OR compute_overage>0 AS has_overage, '2001-12' AS billing_period, $AS_OF AS generated_at FROM o
""")
oracle("license_status", """
SELECT customer_id, tier, billing_period, license_status, peak_active_users, limit_users, user_utilization, peak_opportunities, limit_opportunities, opportunity_utilization, total_api_calls, limit_api_calls, api_utilization, total_compute_hours, limit_compute_hours, compute_utilization, has_overage, up AS upgrade_recommended,
 CASE WHEN up AND tier='starter' THEN 'growth' WHEN up AND tier='growth' THEN 'enterprise' ELSE tier END AS recommended_tier,
 CASE license_status WHEN 'OVERAGE' THEN 'License limits exceeded. ' || CASE WHEN users_overage>0 THEN users_overage || ' extra users. ' ELSE '' END || CASE WHEN opportunities_overage>0 THEN opportunities_overage || ' extra opportunities. ' ELSE '' END WHEN 'WARNING' THEN 'Approaching license limits. Consider upgrading.' ELSE 'License compliant.' END AS compliance_message, $AS_OF AS checked_at
FROM (SELECT *, CASE WHEN has_overage THEN 'OVERAGE' WHEN user_utilization>0.9 OR opportunity_utilization>0.9 OR api_utilization>0.9 THEN 'WARNING' ELSE 'COMPLIANT' END AS license_status, (tier='starter' AND (user_utilization>0.8 OR opportunity_utilization>0.8)) OR (tier='growth' AND (user_utilization>0.8 OR api_utilization>0.8)) AS up FROM usage_summary)
""")
oracle("billing_events", " UNION ALL ".join(f"SELECT customer_id, billing_period, tier, '{k}' AS event_type, {c}::DOUBLE AS quantity, {p}::DOUBLE AS unit_price, round({c}*{p}::DOUBLE,6) AS total_amount, $AS_OF AS event_date, customer_id || '-' || billing_period || '-{k}' AS event_id FROM usage_summary WHERE {c}>0" for k, c, p in (("user_overage", "users_overage", 50), ("opportunity_overage", "opportunities_overage", 0.01), ("api_overage", "api_overage", 0.001), ("compute_overage", "compute_overage", 5))))
PR = {"starter": ("Starter", 499.0, 4990.0), "growth": ("Growth", 1499.0, 14990.0), "enterprise": ("Enterprise", 4999.0, 49990.0)}
_p = lambda i: M("plan_id", {k: v[i] for k, v in PR.items()})
oracle("tenant_plans", f"""
SELECT *, {_p(0)} AS plan_name, CASE WHEN billing_cycle='annual' THEN {_p(2)}/12 ELSE {_p(1)} END AS mrr, CASE WHEN billing_cycle='annual' THEN {_p(2)} ELSE {_p(1)}*12 END AS arr, CASE WHEN NOT coalesce(cancel_at_period_end,false) THEN current_period_end+1 END AS next_billing_date
FROM (SELECT customer_id, customer_name, tier AS plan_id FROM tenant_settings) LEFT JOIN (SELECT * EXCLUDE (event_date, event_seq, rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_date DESC, event_seq DESC) AS rn FROM subscription_events) WHERE rn=1) USING (customer_id)
""")
oracle("billing_summary", f"""
WITH a AS (SELECT * FROM tenant_plans WHERE subscription_status='active'), p AS (SELECT plan_id, count(*) AS n, {S("mrr", None, 4)} AS m FROM a GROUP BY 1)
SELECT count(*) AS total_customers, {S("mrr", None, 4)} AS total_mrr, {S("arr")} AS total_arr, {N("is_trial")} AS trial_customers, {N("cancel_at_period_end")} AS churning_customers, (SELECT '{{' || string_agg('"' || plan_id || '":' || n, ',' ORDER BY plan_id) || '}}' FROM p) AS customers_by_plan,
 (SELECT '{{' || string_agg('"' || plan_id || '":"' || printf('%.2f',m) || '"', ',' ORDER BY plan_id) || '}}' FROM p) AS mrr_by_plan, $AS_OF AS summary_date FROM a
""")
ST = ["onboarding", "connector_setup", "dashboard_config", "agent_training", "live"]
oracle("implementation_status", f"""
WITH s AS (SELECT customer_id, bool_or(sync_type='crm') AS crm_connected, bool_or(sync_type='crm' AND status='success') AS first_sync_complete, max(last_sync_at) AS last_sync_at FROM sync_log WHERE last_sync_at<{END} GROUP BY 1),
b AS (SELECT customer_id, bool_or(feature_name='pipeline_health_dashboard') AS pipeline_dashboard_enabled, bool_or(feature_name='pipeline_hygiene_dashboard') AS hygiene_dashboard_enabled, count(DISTINCT feature_name) AS dashboards_enabled_count FROM feature_events WHERE usage_timestamp<{END} AND feature_name IN ('pipeline_health_dashboard','pipeline_hygiene_dashboard','forecasting_dashboard') GROUP BY 1),
a AS (SELECT customer_id, true AS ops_agent_enabled, bool_or(action_type IS NOT NULL) AS agent_first_action, count(*) AS total_agent_actions, max(executed_at) AS last_agent_action_at FROM agent_actions WHERE executed_at<{END} GROUP BY 1),
j AS (SELECT t.customer_id, customer_name, tier, onboarded_at, coalesce(crm_connected,false) AS crm_connected, coalesce(first_sync_complete,false) AS first_sync_complete, last_sync_at, coalesce(pipeline_dashboard_enabled,false) AS pipeline_dashboard_enabled, coalesce(hygiene_dashboard_enabled,false) AS hygiene_dashboard_enabled, coalesce(dashboards_enabled_count,0) AS dashboards_enabled_count,
 coalesce(ops_agent_enabled,false) AS ops_agent_enabled, coalesce(agent_first_action,false) AS agent_first_action, coalesce(total_agent_actions,0) AS total_agent_actions, last_agent_action_at, coalesce(go_live_approved,false) AS go_live_approved, go_live_date, coalesce(cs_handoff_complete,false) AS cs_handoff_complete, cs_owner
 FROM tenant_settings t LEFT JOIN s USING (customer_id) LEFT JOIN b USING (customer_id) LEFT JOIN a USING (customer_id) LEFT JOIN go_live USING (customer_id)),
k AS (SELECT *, CASE WHEN go_live_approved AND cs_handoff_complete THEN 5 WHEN ops_agent_enabled AND agent_first_action THEN 4 WHEN pipeline_dashboard_enabled AND hygiene_dashboard_enabled THEN 3 WHEN crm_connected AND first_sync_complete THEN 2 ELSE 1 END AS stage_order FROM j)
SELECT *, true AS workspace_created, true AS admin_user_added, {M("stage_order", {i + 1: s for i, s in enumerate(ST)})} AS current_stage, {M("stage_order", {i: s for i, s in enumerate(ST) if i})} AS next_stage, stage_order/5.0*100 AS completion_pct, ($AS_OF-onboarded_at)::INT AS days_in_stage, stage_order<5 AND $AS_OF-onboarded_at>14 AS is_blocked, $AS_OF AS evaluated_at FROM k
""")
oracle("implementation_history", """
WITH p AS (SELECT customer_id, 'onboarding' AS stage FROM tenant_settings), m AS (SELECT customer_id, current_stage AS stage FROM implementation_status s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.customer_id=s.customer_id AND p.stage=s.current_stage))
SELECT customer_id, stage, $AS_OF - 20 AS entered_at, CASE WHEN customer_id IN (SELECT customer_id FROM m) THEN $AS_OF END AS exited_at, CASE WHEN customer_id IN (SELECT customer_id FROM m) THEN 20 END AS duration_days FROM p UNION ALL SELECT customer_id, stage, $AS_OF, NULL, NULL FROM m
""")
oracle("implementation_summary", f"""
WITH p AS (SELECT current_stage, count(*) AS n FROM implementation_status GROUP BY 1)
SELECT *, {R("live_customers", "total_customers", 100, empty=0)} AS live_pct, {R("blocked_customers", "total_customers", 100, empty=0)} AS blocked_pct, (SELECT '{{' || string_agg('"' || current_stage || '":' || n, ',' ORDER BY current_stage) || '}}' FROM p) AS stage_breakdown, $AS_OF AS generated_at
FROM (SELECT count(*) AS total_customers, {N("current_stage='live'")} AS live_customers, {N("is_blocked")} AS blocked_customers, coalesce({A("completion_pct", None, 1)},0) AS avg_completion_pct FROM implementation_status)
""")
oracle("webhook_subscriptions", "SELECT webhook_id, w.customer_id, name, CASE WHEN failure_count>=10 OR tier NOT IN ('growth','enterprise') THEN false ELSE is_active END AS is_active, failure_count, failure_count>=10 AND is_active AS is_disabled_auto FROM webhook_configs w LEFT JOIN tenant_settings t USING (customer_id)")
oracle("webhook_deliveries", """
SELECT d.*, CASE WHEN status='retrying' THEN created_at + to_minutes(pow(2,attempt_count)::INT) END AS next_retry_at, customer_id FROM (SELECT *, CASE WHEN response_code BETWEEN 200 AND 299 THEN 'delivered' WHEN attempt_count>=5 THEN 'failed' WHEN response_code IS NOT NULL THEN 'retrying' ELSE 'pending' END AS status FROM webhook_delivery_log) d
LEFT JOIN (SELECT webhook_id, customer_id FROM webhook_subscriptions) s USING (webhook_id)
""")
oracle("webhook_analytics", f"""
SELECT *, trunc({R("successful_deliveries_24h", "total_deliveries_24h", 100, empty=0)})::INT AS success_rate_pct FROM (SELECT customer_id, webhook_id, count(*) AS total_deliveries_24h, {N("status='delivered'")} AS successful_deliveries_24h, {N("status='failed'")} AS failed_deliveries_24h, trunc(avg(response_time_ms))::INT AS avg_response_time_ms
FROM webhook_deliveries WHERE created_at>=$AS_OF AND created_at<{END} GROUP BY 1,2)
""")
oracle("notification_log", "SELECT * EXCLUDE (body), CASE WHEN error_message IS NOT NULL THEN 'failed' WHEN read_at IS NOT NULL THEN 'read' WHEN delivered_at IS NOT NULL THEN 'delivered' WHEN sent_at IS NOT NULL THEN 'sent' ELSE 'pending' END AS status, CASE WHEN length(body)>200 THEN left(body,197) || '...' ELSE body END AS body_preview FROM notification_events")
oracle("notification_summary", f"""
SELECT *, trunc({R("total_delivered", "total_sent", 100, empty=0)})::INT AS delivery_rate_pct, trunc({R("total_read", "total_delivered", 100, empty=0)})::INT AS read_rate_pct FROM (SELECT sent_at::DATE AS summary_date, customer_id, channel, count(*) AS total_sent, {N("status IN ('delivered','read')")} AS total_delivered, {N("status='read'")} AS total_read, {N("status='failed'")} AS total_failed
FROM notification_log WHERE sent_at IS NOT NULL GROUP BY 1,2,3)
""")
oracle("notification_preferences", "SELECT p.* REPLACE (coalesce(email_enabled,true) AS email_enabled, coalesce(slack_enabled,false) AS slack_enabled, coalesce(in_app_enabled,true) AS in_app_enabled, coalesce(digest_frequency,'daily') AS digest_frequency), alerts_enabled FROM user_preferences p LEFT JOIN (SELECT customer_id, alerts_enabled FROM tenant_settings) USING (customer_id)")
oracle("tenant_health_scores", f"""
WITH f AS (SELECT customer_id, datesub('second', max(last_sync_at), {END})/3600 AS h FROM sync_log WHERE sync_type='crm' AND last_sync_at<{END} GROUP BY 1),
a AS (SELECT u.customer_id, avg(active_users_today) AS avg_daily_users, count(DISTINCT usage_date) AS active_days, any_value(max_users) AS mu FROM usage_daily u LEFT JOIN tenant_settings t USING (customer_id) WHERE usage_date>=$AS_OF-7 GROUP BY 1),
g AS (SELECT customer_id, {N("feedback='accepted'")}/count(*) AS ar FROM agent_actions WHERE executed_at>=$AS_OF-7 AND executed_at<{END} GROUP BY 1), b AS (SELECT customer_id, {N("status='SUCCEEDED'")}/count(*) AS br FROM build_log WHERE build_timestamp>=$AS_OF-7 AND build_timestamp<{END} GROUP BY 1),
j AS (SELECT t.customer_id, customer_name, tier, coalesce(h,24.0) AS hours_since_sync, coalesce(CASE WHEN h IS NOT NULL THEN {L("h", "<=", [(1, 100.0), (4, 90.0), (12, 75.0), (24, 60.0), (48, 40.0)], 20.0)} END,50.0) AS data_freshness_score, coalesce(avg_daily_users,0) AS avg_daily_users, coalesce(active_days,0) AS active_days,
 coalesce({L("active_days", ">=", [(6, 100.0), (4, 80.0), (2, 60.0), (1, 40.0)], 20.0)}*(0.5+0.5*CASE WHEN avg_daily_users IS NOT NULL THEN least(avg_daily_users/mu*100/50,1.0) END),50.0) AS adoption_score, coalesce(ar,0.5) AS acceptance_rate, coalesce(ar*100,50.0) AS ai_accuracy_score, coalesce(br,1.0) AS build_success_rate, coalesce(br*100,100.0) AS build_health_score
 FROM tenant_settings t LEFT JOIN f USING (customer_id) LEFT JOIN a USING (customer_id) LEFT JOIN g USING (customer_id) LEFT JOIN b USING (customer_id)),
k AS (SELECT *, {RD("data_freshness_score*0.25 + adoption_score*0.30 + ai_accuracy_score*0.25 + build_health_score*0.20", 6)} AS composite_score FROM j), l AS (SELECT *, {L("composite_score", "<", [(40, "critical"), (60, "at_risk"), (80, "monitor")], "healthy")} AS health_status FROM k)
SELECT *, {M("health_status", {"critical": "Immediate intervention required. Schedule call within 24 hours.", "at_risk": "Proactive outreach recommended. Check adoption blockers.", "monitor": "Monitor weekly. Consider training refresh."}, "Healthy engagement. Quarterly check-in sufficient.")} AS cs_recommendation FROM l
""")
oracle("tenant_health_trends", f"""
WITH w AS (SELECT customer_id, {RD("composite_score-(customer_id%13-6)", 6)} AS composite_score, health_status, 2001 AS year, 52 AS week_number, $AS_OF - 7 AS snapshot_date FROM tenant_health_scores UNION ALL SELECT customer_id, composite_score, health_status, 2002, 1, $AS_OF FROM tenant_health_scores),
l AS (SELECT *, lag(composite_score) OVER (PARTITION BY customer_id ORDER BY year, week_number) AS prev_score FROM w), c AS (SELECT *, {RD("composite_score-coalesce(prev_score,composite_score)", 6)} AS score_change FROM l)
SELECT *, CASE WHEN score_change>5 THEN 'improving' WHEN score_change<-5 THEN 'declining' ELSE 'stable' END AS trend_direction FROM c
""")
oracle("tenant_roi_baseline", """SELECT account_id AS customer_id, avg(is_won::INT) AS baseline_win_rate, avg(close_date-created_date) AS baseline_avg_cycle_days, count(*)/3.0 AS baseline_deals_per_month, $AS_OF AS baseline_captured_at, 0.70 AS baseline_forecast_accuracy, 60.0 AS baseline_hygiene_score
FROM opportunities WHERE is_closed AND close_date BETWEEN $AS_OF-90 AND $AS_OF AND account_id IN (SELECT customer_id FROM implementation_status WHERE current_stage='live') GROUP BY 1""")
oracle("tenant_roi_current", """
WITH l AS (SELECT customer_id FROM implementation_status WHERE current_stage='live'), r AS (SELECT account_id AS customer_id, avg(is_won::INT) AS current_win_rate, avg(close_date-created_date) AS current_avg_cycle_days, count(*) AS current_deals_per_month FROM opportunities WHERE is_closed AND close_date BETWEEN $AS_OF-30 AND $AS_OF GROUP BY 1),
h AS (SELECT account_id AS customer_id, greatest(100-count(a.opportunity_id)/greatest(count(*),1)*10,0.0) AS current_hygiene_score FROM opportunities o LEFT JOIN (SELECT opportunity_id FROM pipeline_hygiene_alerts) a USING (opportunity_id) WHERE NOT is_closed GROUP BY 1)
SELECT l.customer_id, current_win_rate, current_avg_cycle_days, current_deals_per_month, current_hygiene_score, NULL::DOUBLE AS current_forecast_accuracy, $AS_OF AS metrics_date FROM l LEFT JOIN r USING (customer_id) LEFT JOIN h USING (customer_id)
""")
oracle("tenant_roi_summary", """
WITH j AS (SELECT b.*, c.* EXCLUDE (customer_id, metrics_date), customer_name, tier, ($AS_OF-baseline_captured_at)::INT AS days_live, CASE WHEN baseline_win_rate>0 THEN (current_win_rate-baseline_win_rate)/baseline_win_rate*100 ELSE 0.0 END AS win_rate_improvement_pct, baseline_avg_cycle_days-coalesce(current_avg_cycle_days,baseline_avg_cycle_days) AS cycle_time_reduction_days,
 coalesce(current_forecast_accuracy,0)-baseline_forecast_accuracy AS forecast_accuracy_improvement_pct, coalesce(current_hygiene_score,0)-baseline_hygiene_score AS hygiene_improvement_pct, current_deals_per_month-baseline_deals_per_month AS estimated_deals_gained FROM tenant_roi_baseline b JOIN tenant_roi_current c USING (customer_id) LEFT JOIN (SELECT customer_id, customer_name, tier FROM tenant_settings) t USING (customer_id)),
k AS (SELECT *, CASE WHEN baseline_avg_cycle_days>0 THEN cycle_time_reduction_days/baseline_avg_cycle_days*100 ELSE 0.0 END AS cycle_time_reduction_pct, CASE WHEN win_rate_improvement_pct>0 THEN estimated_deals_gained*50000 ELSE 0.0 END AS estimated_revenue_impact FROM j)
SELECT *, CASE WHEN win_rate_improvement_pct>10 OR cycle_time_reduction_pct>10 THEN 'strong_roi' WHEN win_rate_improvement_pct>0 OR cycle_time_reduction_days>0 THEN 'positive_roi' WHEN days_live<30 THEN 'ramping' ELSE 'needs_attention' END AS roi_status FROM k
""")

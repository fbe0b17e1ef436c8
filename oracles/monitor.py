from oracles import SD, A, L, M, N, R, RD, S, oracle

END = "($AS_OF + 1)::TIMESTAMP"
_h = lambda c: f"datesub('second', {c}, {END})/3600"
_w = lambda c, h: f"{c} > {END} - INTERVAL {h} HOUR AND {c} < {END}"
_prof = lambda t, n: f"SELECT '{t}' AS dataset_path, (SELECT count(*) FROM {t}) AS record_count, {n} AS column_count, round(100.0*((SELECT count(*) FROM {t})*{n} - (SELECT count(*) FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {t}) ON COLUMNS(*))))/greatest((SELECT count(*) FROM {t})*{n},1),4) AS null_pct"
oracle("build_metrics", f"""
SELECT *, status='ok' AS is_healthy, read_latency_ms>5000 AS is_slow, sample_null_pct>20 AS has_quality_issues FROM (SELECT customer_id, dataset_path, split_part(dataset_path,'/',2) AS domain, build_id AS run_id, build_timestamp AS last_build_ts, CASE WHEN status='FAILED' THEN 'error' WHEN record_count<100 THEN 'empty' ELSE 'ok' END AS status,
 CASE WHEN record_count<100 THEN 0 ELSE record_count END AS record_count, (5+build_id%20)::INT AS column_count, floor(duration_seconds*60)::BIGINT AS read_latency_ms, (build_id%45)*0.5 AS sample_null_pct FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, dataset_path ORDER BY build_timestamp DESC, build_id DESC) AS rn FROM build_log WHERE build_timestamp<{END}) WHERE rn=1)
""")
oracle("stale_datasets", f"SELECT *, CASE WHEN status<>'ok' OR age_hours>24 THEN 'critical' WHEN age_hours>6 THEN 'warning' ELSE 'info' END AS alert_level FROM (SELECT *, {_h('last_build_ts')} AS age_hours FROM build_metrics) WHERE age_hours>2 OR status<>'ok'")
oracle("build_summary", f"""
SELECT *, round(healthy_datasets*100/total_datasets,1) AS health_pct, {RD("100-slow_datasets*10-avg_latency_ms/100", 1)} AS performance_score, {RD("100-quality_issue_datasets*10-avg_null_pct", 1)} AS quality_score FROM (SELECT domain, count(*) AS total_datasets, {N("is_healthy")} AS healthy_datasets, {N("status='empty'")} AS empty_datasets, {N("status='error'")} AS error_datasets, sum(record_count)::BIGINT AS total_records,
 max(last_build_ts) AS latest_build, avg(read_latency_ms) AS avg_latency_ms, max(read_latency_ms) AS max_latency_ms, {N("is_slow")} AS slow_datasets, {A("sample_null_pct", None, 1)} AS avg_null_pct, {N("has_quality_issues")} AS quality_issue_datasets, sum(column_count)::BIGINT AS total_columns, max(run_id) AS latest_run_id FROM build_metrics GROUP BY 1)
""")
oracle("pipeline_events", """
WITH e AS (SELECT customer_id, dataset_path, domain, run_id, 'BUILD_COMPLETE' AS event_type, 'info' AS severity, 'Dataset built successfully with ' || format('{:,}', record_count) || ' records' AS message, '{"record_count":' || record_count || ',"column_count":' || column_count || ',"latency_ms":' || read_latency_ms || '}' AS details, false AS requires_action, NULL AS suggested_action FROM build_metrics WHERE status='ok'
UNION ALL SELECT customer_id, dataset_path, domain, run_id, 'BUILD_EMPTY', 'warning', 'Dataset built but contains no records', '{"column_count":' || column_count || ',"latency_ms":' || read_latency_ms || '}', true, 'CHECK_UPSTREAM_DATA' FROM build_metrics WHERE status='empty'
UNION ALL SELECT customer_id, dataset_path, domain, run_id, 'BUILD_ERROR', 'critical', 'Dataset build failed', 'Task failed', true, 'TRIGGER_REBUILD' FROM build_metrics WHERE status='error'
UNION ALL SELECT customer_id, dataset_path, domain, run_id, 'PERFORMANCE_DEGRADED', 'warning', 'Build took ' || read_latency_ms || 'ms (threshold: 5000ms)', '{"latency_ms":' || read_latency_ms || ',"threshold_ms":5000}', true, 'OPTIMIZE_TRANSFORM' FROM build_metrics WHERE is_slow
UNION ALL SELECT customer_id, dataset_path, domain, run_id, 'QUALITY_ALERT', 'warning', 'High null percentage detected: ' || printf('%.1f', sample_null_pct) || '%', '{"null_pct":' || printf('%.1f', sample_null_pct) || '}', true, 'REVIEW_DATA_QUALITY' FROM build_metrics WHERE has_quality_issues
UNION ALL SELECT customer_id, dataset_path, domain, run_id, 'DATASET_STALE', alert_level, 'Dataset is ' || round((age_hours::DOUBLE)::VARCHAR::DECIMAL(38,18),1)::DECIMAL(18,1) || ' hours old', '{"alert_level":"' || alert_level || '"}', true, 'TRIGGER_REBUILD' FROM stale_datasets)
SELECT *, md5(customer_id || '|' || dataset_path || '|' || event_type) AS event_id, $AS_OF AS event_ts, CASE severity WHEN 'critical' THEN 100 WHEN 'warning' THEN 50 WHEN 'info' THEN 10 ELSE 0 END AS priority_score, 'pending' AS action_status FROM e
""")
oracle("ops_agent_queue", f"SELECT * EXCLUDE (requires_action, run_id), {M('suggested_action', {'TRIGGER_REBUILD': 15, 'CHECK_UPSTREAM_DATA': 30, 'OPTIMIZE_TRANSFORM': 60, 'REVIEW_DATA_QUALITY': 45}, 30)} AS estimated_resolution_min, (row_number() OVER (ORDER BY priority_score DESC, event_id DESC))::BIGINT AS queue_position FROM pipeline_events WHERE requires_action")
oracle("tenant_alert_thresholds", "SELECT customer_id, CASE customer_id%3 WHEN 0 THEN 0.10 WHEN 1 THEN 0.50 ELSE 0.75 END AS stale_pct_threshold, CASE WHEN customer_id%2=0 THEN 0.90 ELSE 0.97 END AS data_quality_threshold, CASE WHEN customer_id%4=0 THEN 60 ELSE 600 END AS sync_delay_threshold FROM tenant_settings")
oracle("previous_alerts", f"""SELECT customer_id, alert_type, triggered_at, 'warning' AS severity, NULL::DOUBLE AS metric_value, NULL::DOUBLE AS threshold, 'stored' AS message, false AS is_resolved, NULL::TIMESTAMP AS resolved_at FROM (SELECT customer_id, 'stale_pipeline' AS alert_type, {END} - INTERVAL 30 MINUTE AS triggered_at FROM tenant_settings WHERE customer_id%3=0
 UNION ALL SELECT customer_id, 'sync_delay', {END} - INTERVAL 30 HOUR FROM tenant_settings WHERE customer_id%5=0)""")
oracle("alert_history", f"""
WITH d AS (SELECT account_id AS customer_id, {N("days_since_activity>14")} AS stale, count(*) AS n, (count(owner_id)+count(next_step)+count(competitor_mentioned)+count(close_date))/(count(*)*4) AS q FROM deal_health GROUP BY 1),
t AS (SELECT d.*, stale/n AS sp, coalesce(stale_pct_threshold,0.10) AS st, coalesce(data_quality_threshold,0.90) AS qt FROM d LEFT JOIN tenant_alert_thresholds USING (customer_id)),
y AS (SELECT s.*, datesub('minute', ls, {END}) AS delay, coalesce(sync_delay_threshold,60) AS lim FROM (SELECT customer_id, source_system, max(last_sync_at) AS ls FROM sync_log WHERE last_sync_at<{END} GROUP BY 1,2) s LEFT JOIN tenant_alert_thresholds USING (customer_id)),
n AS (SELECT customer_id, 'build_failure' AS alert_type, 'critical' AS severity, NULL::DOUBLE AS metric_value, NULL::DOUBLE AS threshold, 'Build failed for ' || dataset_path || ': ' || error_message AS message FROM build_log WHERE status='FAILED' AND {_w("build_timestamp", 1)}
 UNION ALL SELECT customer_id, 'stale_pipeline', 'warning', sp, st, stale || ' deals need attention.' FROM t WHERE sp>st UNION ALL SELECT customer_id, 'data_quality_drop', 'warning', q, qt, 'Data quality below threshold.' FROM t WHERE q<qt
 UNION ALL SELECT customer_id, 'sync_delay', 'warning', delay, lim, source_system || ' sync delayed by ' || delay || ' minutes' FROM y WHERE delay>lim),
m AS (SELECT * FROM previous_alerts UNION ALL BY NAME SELECT *, {END} AS triggered_at, false AS is_resolved, NULL::TIMESTAMP AS resolved_at FROM n WHERE NOT EXISTS (SELECT 1 FROM previous_alerts p WHERE p.alert_type=n.alert_type AND p.customer_id=n.customer_id AND {_w("p.triggered_at", 1)}))
SELECT * REPLACE (is_resolved OR triggered_at < {END} - INTERVAL 24 HOUR AS is_resolved, CASE WHEN is_resolved OR triggered_at < {END} - INTERVAL 24 HOUR THEN coalesce(resolved_at, {END}) END AS resolved_at) FROM m
""")
oracle("active_alerts", f"SELECT *, CASE WHEN severity='critical' THEN 1 WHEN age_hours>12 THEN 2 WHEN severity='warning' THEN 3 ELSE 4 END AS urgency FROM (SELECT *, {_h('triggered_at')} AS age_hours FROM alert_history WHERE NOT is_resolved)")
_n = lambda h: f"triggered_at > {END} - INTERVAL {h} HOUR"
oracle("tenant_alert_summary", f"""SELECT customer_id, {N("NOT is_resolved")} AS active_count, {N("NOT is_resolved AND severity='critical'")} AS critical_active, {N(_n(24))} AS alerts_24h, {N(_n(168))} AS alerts_7d, {N(_n(720))} AS alerts_30d,
 {", ".join(N(f"alert_type='{k}' AND {_n(168)}") + f" AS {n}" for n, k in (("build_failures_7d", "build_failure"), ("stale_alerts_7d", "stale_pipeline"), ("quality_alerts_7d", "data_quality_drop"), ("sync_alerts_7d", "sync_delay")))},
 avg(datesub('second', triggered_at, resolved_at)) FILTER (WHERE is_resolved)/3600 AS avg_resolution_hours FROM alert_history GROUP BY 1""")
oracle("system_health", f"""
WITH b AS (SELECT customer_id, count(*) AS total_builds, {N("status='SUCCEEDED'")} AS successful_builds, {N("status<>'SUCCEEDED'")} AS failed_builds, {A("duration_seconds")} AS avg_build_duration, {N("status='SUCCEEDED'")}/count(*) AS build_success_rate FROM build_log WHERE {_w("build_timestamp", 24)} GROUP BY 1),
s AS (SELECT customer_id, {N("status='success'")} AS successful_syncs, count(*) AS total_syncs, {N("status='success'")}/count(*) AS sync_success_rate, {_h("max(last_sync_at)")} AS sync_age_hours FROM sync_log WHERE last_sync_at<{END} GROUP BY 1),
q AS (SELECT account_id AS customer_id, count(owner_id)/count(*) AS avg_data_quality FROM deal_health GROUP BY 1), a AS (SELECT customer_id, count(*) AS active_alert_count, {N("severity='critical'")} AS critical_alerts, {N("severity='warning'")} AS warning_alerts FROM active_alerts GROUP BY 1),
j AS (SELECT * REPLACE (coalesce(build_success_rate,1.0) AS build_success_rate, coalesce(sync_success_rate,1.0) AS sync_success_rate, coalesce(avg_data_quality,1.0) AS avg_data_quality, coalesce(sync_age_hours,0.0) AS sync_age_hours, coalesce(active_alert_count,0) AS active_alert_count, coalesce(critical_alerts,0) AS critical_alerts, coalesce(warning_alerts,0) AS warning_alerts)
 FROM b FULL JOIN s USING (customer_id) FULL JOIN q USING (customer_id) FULL JOIN a USING (customer_id)),
k AS (SELECT *, {RD("build_success_rate*25 + sync_success_rate*25 + avg_data_quality*25 + greatest(0, 25-critical_alerts*10-warning_alerts*2)", 6)} AS health_score FROM j)
SELECT *, CASE WHEN critical_alerts>0 THEN 'Critical' WHEN health_score<60 THEN 'Degraded' WHEN health_score<80 THEN 'Warning' ELSE 'Healthy' END AS health_status FROM k
""")
oracle("build_performance", f"""
SELECT *, success_count/build_count AS success_rate, failure_count/build_count AS failure_rate FROM (SELECT customer_id, dataset_path, w AS time_window, count(*) AS build_count, {N("status='SUCCEEDED'")} AS success_count, {N("status<>'SUCCEEDED'")} AS failure_count, {A("duration_seconds")} AS avg_duration_seconds, min(duration_seconds) AS min_duration_seconds,
 max(duration_seconds) AS max_duration_seconds, quantile_disc(duration_seconds,0.5) AS p50_duration, quantile_disc(duration_seconds,0.95) AS p95_duration, quantile_disc(duration_seconds,0.99) AS p99_duration FROM build_log, (VALUES ('1h',1),('24h',24),('7d',168),('30d',720)) v(w,h) WHERE build_timestamp > {END} - to_hours(h) AND build_timestamp < {END} GROUP BY 1,2,3)
""")
oracle("data_freshness", f"""
SELECT f.*, last_sync_time, {_h("last_sync_time")} AS hours_since_sync FROM (SELECT *, hours_since_build > expected_freshness_hours AS is_overdue FROM (SELECT *, hours_since_build/24 AS days_since_build, {L("hours_since_build", "<=", [(1, "Fresh"), (6, "Recent"), (24, "Stale")], "Critical")} AS freshness_status,
 CASE WHEN dataset_path LIKE '%Staging%' THEN 1 WHEN dataset_path LIKE '%Enriched%' THEN 4 WHEN dataset_path LIKE '%Analytics%' THEN 12 ELSE 24 END AS expected_freshness_hours FROM (SELECT customer_id, dataset_path, max(build_timestamp) AS last_successful_build, count(*) AS total_builds, {_h("max(build_timestamp)")} AS hours_since_build FROM build_log WHERE status='SUCCEEDED' AND build_timestamp<{END} GROUP BY 1,2))) f
 LEFT JOIN (SELECT customer_id, max(last_sync_at) AS last_sync_time FROM sync_log WHERE last_sync_at<{END} GROUP BY 1) USING (customer_id)
""")
oracle("usage_metrics", f"""
SELECT u.*, subscription_tier, user_limit, builds_30d/30 AS avg_builds_per_day, total_compute_seconds/30/60 AS avg_compute_minutes_per_day, least(100.0, active_days/30*100) AS activity_score FROM (SELECT customer_id, count(*) AS builds_30d, count(DISTINCT dataset_path) AS datasets_built, {S("duration_seconds")} AS total_compute_seconds, count(DISTINCT build_timestamp::DATE) AS active_days FROM build_log WHERE {_w("build_timestamp", 720)} GROUP BY 1) u
LEFT JOIN (SELECT customer_id, tier AS subscription_tier, max_users AS user_limit FROM tenant_settings) USING (customer_id)
""")
oracle("sla_tracking", f"""
SELECT *, coalesce(build_sla_met,true) AND coalesce(freshness_sla_met,true) AS overall_sla_met, CASE WHEN coalesce(build_sla_met,true) AND coalesce(freshness_sla_met,true) THEN 'Compliant' ELSE 'Breach' END AS sla_status
FROM (SELECT *, successful_builds/total_builds AS build_success_rate, successful_builds/total_builds>=0.99 AS build_sla_met FROM (SELECT customer_id, count(*) AS total_builds, {N("status='SUCCEEDED'")} AS successful_builds FROM build_log WHERE {_w("build_timestamp", 720)} GROUP BY 1))
FULL JOIN (SELECT *, fresh_datasets/total_datasets AS freshness_rate, fresh_datasets/total_datasets>=0.95 AS freshness_sla_met FROM (SELECT customer_id, count(*) AS total_datasets, {N("NOT is_overdue")} AS fresh_datasets, {N("is_overdue")} AS overdue_datasets FROM data_freshness GROUP BY 1)) USING (customer_id)
""")
oracle("agent_decisions", f"""
WITH f AS (SELECT customer_id, dataset_path, count(*) AS fc FROM build_log WHERE status='FAILED' AND build_timestamp>=$AS_OF-7 AND build_timestamp<{END} GROUP BY 1,2),
c AS (SELECT q.*, round(greatest(0.0,least(1.0,0.8 + CASE severity WHEN 'critical' THEN -0.1 WHEN 'info' THEN 0.1 ELSE 0.0 END + CASE WHEN coalesce(fc,0)>2 THEN -0.2 WHEN coalesce(fc,0)>0 THEN -0.1 ELSE 0.0 END + {M("suggested_action", {"TRIGGER_REBUILD": 0.1, "CHECK_UPSTREAM_DATA": 0.0, "OPTIMIZE_TRANSFORM": -0.2, "REVIEW_DATA_QUALITY": -0.1}, 0.0)})),2) AS confidence FROM ops_agent_queue q LEFT JOIN f USING (customer_id, dataset_path)),
d AS (SELECT *, CASE WHEN suggested_action IN ('TRIGGER_REBUILD','CHECK_UPSTREAM_DATA') AND confidence>=0.7 THEN 'auto_execute' WHEN confidence>=0.5 THEN 'recommend' ELSE 'escalate' END AS decision FROM c)
SELECT md5('decision|' || event_id) AS decision_id, event_id, customer_id, dataset_path, suggested_action, severity, confidence, decision, CASE decision WHEN 'auto_execute' THEN 'Confidence ' || printf('%.2f',confidence) || ' above threshold' WHEN 'recommend' THEN 'Confidence ' || printf('%.2f',confidence) || ' - recommend with review' ELSE 'Low confidence ' || printf('%.2f',confidence) || ' - requires human decision' END AS decision_reason,
 $AS_OF AS decision_ts, decision<>'auto_execute' OR severity='critical' AS requires_human_review, CASE WHEN severity='critical' THEN 'pagerduty' WHEN decision<>'auto_execute' THEN 'slack' END AS escalation_channel FROM d
""")
oracle("agent_action_log", "SELECT decision_id AS action_id, event_id, customer_id, dataset_path, suggested_action AS action_type, confidence, decision_ts AS initiated_ts, 'in_progress' AS outcome, decision_reason AS agent_reasoning FROM agent_decisions WHERE decision='auto_execute'")
oracle("escalation_queue", "SELECT decision_id AS escalation_id, event_id, customer_id, dataset_path, suggested_action, confidence, decision, decision_reason, escalation_channel, decision_ts AS escalation_ts, 'pending' AS escalation_status, CASE WHEN escalation_channel='pagerduty' OR confidence<0.3 THEN 'high' ELSE 'normal' END AS urgency FROM agent_decisions WHERE requires_human_review")
oracle("agent_performance", f"""
SELECT *, {RD("(CASE WHEN total_actions>0 THEN successful_actions::DOUBLE/total_actions ELSE 1.0 END*0.7 + (1-escalation_rate)*0.3)*100", 1)} AS agent_health_score FROM (SELECT *, $AS_OF AS metric_ts, {R("successful_actions", "total_actions", empty=0)} AS success_rate, {R("total_escalations", "total_actions+total_escalations", empty=0)} AS escalation_rate
FROM (SELECT count(*) AS total_actions, {N("outcome='success'")} AS successful_actions, {N("outcome='failed'")} AS failed_actions, coalesce({A("confidence")},0) AS avg_confidence FROM agent_action_log), (SELECT count(*) AS total_escalations, {N("escalation_status='resolved'")} AS resolved_escalations FROM escalation_queue))
""")
oracle("agent_status_dashboard", f"""SELECT *, {L("agent_health_score", ">=", [(80, "healthy"), (60, "degraded")], "unhealthy")} AS agent_status FROM agent_performance, (SELECT count(*) AS queue_depth, {N("severity='critical'")} AS critical_items, sum(estimated_resolution_min)::BIGINT AS total_estimated_minutes FROM ops_agent_queue),
 (SELECT count(*) AS decisions_24h, {N("decision='auto_execute'")} AS auto_executed_24h, {N("decision='escalate'")} AS escalated_24h, {A("confidence")} AS avg_confidence_24h FROM agent_decisions)""")
oracle("escalation_notifications", "SELECT md5('notification|' || escalation_id) AS notification_id, escalation_id, escalation_channel AS channel, escalation_ts AS sent_ts, 'queued' AS delivery_status, '[' || upper(urgency) || '] ' || dataset_path || ': ' || replace(suggested_action,'_',' ') || ' (' || decision_reason || ')' AS message_content, CASE WHEN escalation_channel='pagerduty' THEN 'oncall' WHEN urgency='high' THEN '#ops-critical' ELSE '#ops-alerts' END AS recipient FROM escalation_queue")
oracle("escalation_tracker", "SELECT e.*, sent_ts, delivery_status, channel, recipient, 24.0 AS hours_since_escalation, true AS is_overdue, 'critical' AS urgency_level FROM escalation_queue e LEFT JOIN escalation_notifications n USING (escalation_id)")
oracle("action_feedback", """
SELECT *, coalesce(action_type='TRIGGER_REBUILD' AND current_is_healthy AND latest_build_ts>execution_ts::TIMESTAMP,false) OR execution_status='success' AS action_effective FROM (SELECT action_id AS execution_id, event_id, customer_id, dataset_path, action_type, initiated_ts AS execution_ts, CASE WHEN confidence>=0.75 THEN 'success' ELSE 'failed' END AS execution_status FROM agent_action_log)
LEFT JOIN (SELECT customer_id, dataset_path, status AS current_status, is_healthy AS current_is_healthy, last_build_ts AS latest_build_ts FROM build_metrics) USING (customer_id, dataset_path)
""")
oracle("api_build_requests", """SELECT md5('request|' || event_id) AS request_id, event_id, dataset_path, '{"dataset":"' || md5(dataset_path) || '","branch":"master","abortOnFailure":true,"retryCount":1}' AS request_payload, event_ts AS created_ts, 'pending' AS execution_status FROM ops_agent_queue WHERE suggested_action='TRIGGER_REBUILD'""")
oracle("review_tickets", """SELECT md5('ticket|' || decision_id) AS ticket_id, decision_id, dataset_path, CASE WHEN o THEN 'optimization' ELSE 'data_quality' END AS ticket_type, CASE WHEN o THEN 'Optimize transform: ' ELSE 'Data quality review: ' END || split_part(dataset_path,'/',3) AS summary, CASE WHEN o THEN 'Medium' ELSE 'High' END AS priority,
 CASE WHEN o THEN '["sales-ops","optimization","auto-generated"]' ELSE '["sales-ops","data-quality","auto-generated"]' END AS labels, decision_ts AS created_ts FROM (SELECT *, suggested_action='OPTIMIZE_TRANSFORM' AS o FROM agent_decisions WHERE suggested_action IN ('OPTIMIZE_TRANSFORM','REVIEW_DATA_QUALITY') AND requires_human_review)""")
oracle("chat_messages", """SELECT md5('message|' || escalation_id) AS message_id, escalation_id, CASE WHEN urgency='high' THEN '#ops-critical' ELSE '#ops-alerts' END AS channel, '[{"type":"header","text":"Agent Escalation"},{"type":"section","text":"Dataset: ' || dataset_path || '"},{"type":"section","text":"Reason: ' || decision_reason || '"}]' AS message_blocks, escalation_ts AS created_ts, 'pending' AS sent_status FROM escalation_queue WHERE escalation_channel='slack'""")
oracle("paging_incidents", "SELECT md5('incident|' || escalation_id) AS incident_id, escalation_id, 'Pipeline Alert: ' || split_part(dataset_path,'/',3) AS title, CASE WHEN urgency='high' THEN 'high' ELSE 'low' END AS urgency, 'Dataset: ' || dataset_path || '. Reason: ' || decision_reason AS body, escalation_ts AS created_ts FROM escalation_queue WHERE escalation_channel='pagerduty'")
oracle("api_execution_summary", "SELECT *, build_api_requests+tickets_created+chat_messages_sent+paging_incidents AS total_api_calls, $AS_OF AS summary_ts FROM (SELECT count(*) AS build_api_requests FROM api_build_requests), (SELECT count(*) AS tickets_created FROM review_tickets), (SELECT count(*) AS chat_messages_sent FROM chat_messages), (SELECT count(*) AS paging_incidents FROM paging_incidents)")
oracle("threshold_recommendations", f"""
WITH s AS (SELECT coalesce({A("avg_latency_ms", None, 4)},0) AS a, coalesce(round({SD("avg_latency_ms", 4)},4),0) AS sd, coalesce({A("avg_null_pct", None, 4)},0) AS nl, coalesce(avg(quality_issue_datasets),0) AS iss FROM build_summary), e AS (SELECT {N("action_effective")}/greatest(count(*),1) AS rate, count(*) AS n FROM action_feedback),
x AS (SELECT *, a+sd*2 AS hi, a+sd*3 AS lo FROM s, e),
r AS (SELECT 'latency_threshold_ms' AS config_key, '5000' AS current_value, trunc(hi)::INT::VARCHAR AS recommended_value, 0.8 AS confidence, 'Reduce false positive slow alerts' AS impact FROM x WHERE hi>5000 UNION ALL SELECT 'latency_threshold_ms', '5000', greatest(1000,trunc(lo)::INT)::VARCHAR, 0.7, 'Earlier detection of performance degradation' FROM x WHERE hi<=5000 AND lo<2500
 UNION ALL SELECT 'null_percentage_threshold', '20.0', '10.0', 0.75, 'Catch data quality issues earlier' FROM x WHERE nl<5 AND iss=0 UNION ALL SELECT 'agent_confidence_threshold', '0.7', '0.8', 0.85, 'Fewer unsuccessful auto-remediation attempts' FROM x WHERE n>10 AND rate<0.6 UNION ALL SELECT 'agent_confidence_threshold', '0.7', '0.6', 0.7, 'More issues auto-remediated' FROM x WHERE n>10 AND rate>0.9)
SELECT * FROM r UNION ALL SELECT 'SYSTEM_STATUS', 'N/A', 'N/A', 1.0, 'No changes needed' WHERE NOT EXISTS (SELECT 1 FROM r)
""")
oracle("model_performance_metrics", f"""
SELECT *, high>0.5 OR low>0.5 OR confidence_stddev<0.1 AS drift_detected, CASE WHEN high>0.5 OR low>0.5 OR confidence_stddev<0.1 THEN 'warning' ELSE 'info' END AS alert_level, 'deal_win_predictor' AS model_name, $AS_OF AS metric_ts FROM (SELECT count(*) AS prediction_count, {A("win_probability/100", None, 3)} AS avg_confidence, round({SD("win_probability/100", 6)},6) AS confidence_stddev,
 {N("win_probability/100>0.7")}/count(*) AS high, {N("win_probability/100<0.3")}/count(*) AS low, (count(*)-{N("win_probability/100>0.7")}-{N("win_probability/100<0.3")})/count(*) AS medium FROM deal_predictions)
""")
oracle("model_explanations", """
WITH f AS (SELECT opportunity_id, win_probability, unnest(['health','activity_recency','stakeholder','velocity']) AS f, unnest([health_factor::DOUBLE,activity_recency_factor,stakeholder_factor,velocity_factor]) AS v FROM deal_predictions),
r AS (SELECT *, row_number() OVER (PARTITION BY opportunity_id ORDER BY v DESC, f) AS up, row_number() OVER (PARTITION BY opportunity_id ORDER BY v, f DESC) AS dn FROM f)
SELECT opportunity_id, any_value(win_probability) AS prediction, string_agg(f, ', ' ORDER BY up) FILTER (WHERE up<=3) AS top_positive_factors, string_agg(f, ', ' ORDER BY dn) FILTER (WHERE dn<=3) AS top_negative_factors, CASE WHEN any_value(win_probability)>60 THEN 'likely to win' WHEN any_value(win_probability)>40 THEN 'at risk' ELSE 'unlikely to close' END AS outcome FROM r GROUP BY 1
""")
WZ = ["connect_crm", "import_users", "configure_stages", "set_quotas", "enable_forecasting", "configure_alerts", "invite_team"]
WT = ["datasets_built>0", "builds_30d>5", "datasets_built>3", "activity_score>30", "activity_score>50", "activity_score>70", "activity_score>90"]
oracle("onboarding_progress", f"""
SELECT *, 7 AS total_steps, completed_count/7*100 AS progress_pct, list_filter({WZ}, lambda v: NOT list_contains(completed_steps, v))[1] AS next_step, completed_count>=3 AS is_complete, completed_count=7 AS is_fully_complete FROM (SELECT *, len(completed_steps)::INT AS completed_count FROM (SELECT customer_id, activity_score, list_filter([{", ".join(f"CASE WHEN {t} THEN '{s}' END" for t, s in zip(WT, WZ))}], lambda v: v IS NOT NULL) AS completed_steps FROM usage_metrics))
""")
oracle("usage_recommendations", """
WITH u AS (SELECT m.*, coalesce(user_utilization,0) AS uu, coalesce(api_utilization,0) AS au, coalesce(compute_utilization,0) AS cu FROM usage_metrics m LEFT JOIN (SELECT customer_id, user_utilization, api_utilization, compute_utilization FROM license_status) USING (customer_id))
SELECT *, false AS dismissed FROM (SELECT customer_id, 'upgrade' AS rec_type, 'capacity' AS category, 'User Limit Approaching' AS title, 'You''re using ' || printf('%.0f',uu*100) || '% of your user limit. Consider upgrading to avoid disruption.' AS description, 'high' AS priority, 'UPGRADE_TIER' AS suggested_action FROM u WHERE uu>0.8
UNION ALL SELECT customer_id, 'optimization', 'efficiency', 'API Usage Optimization', 'High API usage detected. Consider batching requests or enabling caching.', 'medium', 'REVIEW_API_USAGE' FROM u WHERE au>0.7 UNION ALL SELECT customer_id, 'upgrade', 'capacity', 'Compute Capacity Alert', 'Using ' || printf('%.0f',cu*100) || '% of compute hours. Consider upgrading or optimizing transforms.', 'high', 'UPGRADE_OR_OPTIMIZE' FROM u WHERE cu>0.8
UNION ALL SELECT customer_id, 'engagement', 'adoption', 'Low Engagement Detected', 'Your team isn''t fully utilizing the product. Book a training session!', 'medium', 'SCHEDULE_TRAINING' FROM u WHERE activity_score<20 UNION ALL SELECT customer_id, 'upgrade', 'features', 'Power User Detected', 'You''re getting great value! Upgrade to Growth for AI features.', 'low', 'EXPLORE_GROWTH_TIER' FROM u WHERE activity_score>80 AND subscription_tier='starter'
UNION ALL SELECT customer_id, 'adoption', 'features', 'Underutilized Features', 'You have access to AI forecasting and custom reports. Start using them!', 'medium', 'ENABLE_AI_FEATURES' FROM u WHERE subscription_tier IN ('growth','enterprise') AND activity_score<60)
""")
oracle("integration_opportunities", "SELECT customer_id, integration_type, estimated_value, complexity, 'suggested' AS status FROM usage_metrics, (VALUES (30,'marketing_automation','15% better lead scoring','low'),(50,'support_system','20% faster churn detection','medium'),(70,'business_intelligence','Executive dashboard capabilities','low')) v(b,integration_type,estimated_value,complexity) WHERE activity_score>b")
oracle("config_validation_results", """
SELECT *, CASE WHEN issue_count=0 THEN 'valid' ELSE 'invalid' END AS validation_status, CASE WHEN len(missing_steps)>0 THEN 'Complete the ''' || missing_steps[1] || ''' step in the setup wizard' WHEN progress_pct<50 THEN 'Continue with the setup wizard to unlock all features' ELSE 'No action needed' END AS next_action
FROM (SELECT *, (len(missing_steps)+(progress_pct<50)::INT)::INT AS issue_count FROM (SELECT customer_id, progress_pct, list_filter(['connect_crm','import_users','configure_stages'], lambda v: NOT list_contains(completed_steps, v)) AS missing_steps FROM onboarding_progress))
""")
oracle("self_service_dashboard", """
SELECT *, CASE WHEN config_status='invalid' THEN 'needs_attention' WHEN onboarding_pct<50 THEN 'setup_incomplete' WHEN active_recommendations>3 THEN 'opportunities_available' WHEN onboarding_pct=100 THEN 'excellent' ELSE 'good' END AS overall_health
FROM (SELECT o.customer_id, is_complete AS onboarding_complete, o.progress_pct AS onboarding_pct, next_step AS next_wizard_step, coalesce(r,0) AS active_recommendations, coalesce(i,0) AS integration_opportunities, coalesce(validation_status,'unknown') AS config_status FROM onboarding_progress o LEFT JOIN (SELECT customer_id, count(*) AS r FROM usage_recommendations GROUP BY 1) USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS i FROM integration_opportunities GROUP BY 1) USING (customer_id) LEFT JOIN (SELECT customer_id, validation_status FROM config_validation_results) USING (customer_id))
""")

from oracles import A, L, M, N, R, RD, oracle

oracle("product_usage", f"""
WITH d AS (SELECT account_id, event_timestamp::DATE AS usage_date, count(DISTINCT user_id) AS daily_active_users, count(*) AS total_events, count(DISTINCT event_name) AS features_used, {N("event_name LIKE '%core%'")} AS core_feature_events,
 {N("event_name LIKE '%premium%'")} AS premium_feature_events, max(event_timestamp) AS last_activity FROM product_events GROUP BY 1,2),
e AS (SELECT *, (sum(daily_active_users) OVER (PARTITION BY account_id ORDER BY usage_date ROWS 6 PRECEDING))::BIGINT AS wau, (sum(daily_active_users) OVER (PARTITION BY account_id ORDER BY usage_date ROWS 29 PRECEDING))::BIGINT AS mau,
 {RD("daily_active_users*0.3 + features_used*0.3 + least(total_events/100,10.0)*0.4", 1)} AS engagement_score FROM d),
f AS (SELECT *, lag(engagement_score,7) OVER (PARTITION BY account_id ORDER BY usage_date) AS p FROM e)
SELECT * EXCLUDE (p), {L("engagement_score", ">=", [(7, "Healthy"), (4, "Monitor"), (2, "At Risk")], "Critical")} AS usage_health, CASE WHEN engagement_score>p THEN 'increasing' WHEN engagement_score<p THEN 'decreasing' ELSE 'stable' END AS usage_trend FROM f
""")
oracle("active_users_calendar", """
WITH s AS (SELECT DISTINCT account_id, user_id, event_timestamp::DATE AS day FROM product_events), d AS (SELECT DISTINCT account_id, day AS usage_date FROM s)
SELECT d.account_id, usage_date, count(DISTINCT CASE WHEN usage_date-day<=6 THEN user_id END) AS true_wau, count(DISTINCT user_id) AS true_mau
FROM d JOIN s ON s.account_id=d.account_id AND day BETWEEN usage_date-29 AND usage_date GROUP BY 1,2
""")
oracle("support_tickets", f"""
SELECT *, severity IN ('Critical','High') AS is_escalated, status NOT IN ('solved','closed') AS is_open, {M("severity", {"Critical": 10, "High": 5, "Medium": 2}, 1)} AS support_impact_score, 'Helpdesk' AS source_system
FROM (SELECT id AS ticket_id, coalesce(account_id, organization_id) AS account_id, subject, status, {M("priority", {"urgent": "Critical", "high": "High", "normal": "Medium"}, "Low")} AS severity, created_at AS created_date, solved_at AS resolved_date,
 requester_email, satisfaction_rating, {RD("datesub('second', created_at, solved_at)/3600", 1)} AS resolution_hours FROM tickets_raw t LEFT JOIN account_domains d ON d.domain=regexp_extract(requester_email,'@(.+)$',1))
""")
oracle("support_health_by_account", f"""
SELECT *, {L("support_health_score", ">=", [(80, "Healthy"), (60, "Monitor"), (40, "At Risk")], "Critical")} AS support_health_status
FROM (SELECT *, greatest(0, 100-critical_tickets*20-high_tickets*10-open_tickets*5-CASE WHEN avg_resolution_hours>48 THEN 10 ELSE 0 END)::BIGINT AS support_health_score
FROM (SELECT account_id, count(*) AS total_tickets_30d, {N("is_open")} AS open_tickets, {N("severity='Critical'")} AS critical_tickets, {N("severity='High'")} AS high_tickets, {A("resolution_hours", None, 1)} AS avg_resolution_hours,
 avg(satisfaction_rating) AS avg_csat, sum(support_impact_score)::BIGINT AS total_impact_score, max(created_date) AS last_ticket_date FROM support_tickets GROUP BY 1))
""")
TT = {6: "Email Sent", 7: "Email Delivered", 8: "Email Bounced", 9: "Email Unsubscribed", 10: "Email Opened", 11: "Email Clicked", 2: "Form Filled", 1: "Page Visit"}
oracle("marketing_touches", f"""
SELECT *, touch_type IN ('Email Opened','Email Clicked','Form Filled') AS is_engagement, {M("touch_type", {"Form Filled": 10, "Email Clicked": 5, "Email Opened": 2, "Page Visit": 1}, 0)} AS touch_score, 'Marketing' AS source_system
FROM (SELECT id AS touch_id, "leadId" AS contact_id, {M('"activityTypeId"', TT, "Other")} AS touch_type, "activityDate" AS touch_date, "campaignId" AS campaign_id, "primaryAttributeValue" AS asset_name FROM marketing_raw)
""")
oracle("unified_timeline", """
SELECT md5('CRM|' || activity_id) AS event_id, account_id, opportunity_id, activity_date AS event_date, activity_type AS event_type, 'Sales' AS event_category, subject AS event_description, owner_id::VARCHAR AS actor, 5.0 AS engagement_score, 'CRM' AS source_system FROM activities
UNION ALL SELECT md5('Product Analytics|' || account_id || '|' || usage_date), account_id, NULL, usage_date, 'Product Usage', 'Product', 'DAU: ' || daily_active_users, 'System', engagement_score, 'Product Analytics' FROM product_usage
UNION ALL SELECT md5('Helpdesk|' || ticket_id), account_id, NULL, created_date::DATE, 'Support Ticket: ' || severity, 'Support', subject, requester_email, support_impact_score, 'Helpdesk' FROM support_tickets
UNION ALL SELECT md5('Marketing|' || touch_id), NULL, NULL, touch_date::DATE, touch_type, 'Marketing', asset_name, contact_id::VARCHAR, touch_score, 'Marketing' FROM marketing_touches WHERE is_engagement
""")
oracle("feature_usage", f"""
SELECT *, {L("feature_adoption_score", ">=", [(70, "Power User"), (40, "Active User"), (20, "Light User")], "At Risk")} AS adoption_tier, {R("premium_feature_usage", "core_feature_usage+premium_feature_usage", 100, 1, 0)} AS premium_usage_pct, $AS_OF AS snapshot_date
FROM (SELECT *, {RD("total_features_used/30*0.4 + active_days_30d/30*0.3 + avg_engagement_score/10*0.3", 2)}*100 AS feature_adoption_score FROM (SELECT account_id, sum(features_used)::BIGINT AS total_features_used, sum(core_feature_events)::BIGINT AS core_feature_usage,
 sum(premium_feature_events)::BIGINT AS premium_feature_usage, {A("engagement_score", None, 1)} AS avg_engagement_score, count(*) AS active_days_30d, max(usage_date) AS last_active_date, min(usage_date) AS first_active_date FROM product_usage GROUP BY 1))
""")

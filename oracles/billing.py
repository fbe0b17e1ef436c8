from oracles import A, L, M, N, R, RD, S, oracle
from quotaloom.operators.billing import METRIC_RULES, PLAN_LIMITS

END = "($AS_OF + 1)::TIMESTAMP"
oracle("subscriptions", """SELECT c_custkey AS tenant_id, CASE c_custkey%3 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' ELSE 'enterprise' END AS plan_code, CASE WHEN c_custkey%2=0 THEN 'annual' ELSE 'monthly' END AS billing_interval, ((c_custkey%6)*5)::INT AS discount_percent, CASE c_custkey%6 WHEN 0 THEN 'US' WHEN 1 THEN 'EU' WHEN 2 THEN 'UK' WHEN 3 THEN 'APAC' WHEN 4 THEN 'LATAM' ELSE 'GLOBAL' END AS region,
 c_custkey%4=0 AS has_tax_id, $AS_OF - (c_custkey%300)::INT AS contract_start, ($AS_OF - (c_custkey%300)::INT + INTERVAL 12 MONTHS)::DATE AS contract_end, 12 AS term_months, c_custkey%7=0 AS cancel_at_period_end, CASE WHEN c_custkey%5=0 THEN $AS_OF + (c_custkey%10)::INT END AS trial_ends FROM customer""")
oracle("subscription_add_ons", """SELECT tenant_id, add_on, (1+tenant_id%3)::INT AS quantity, CASE WHEN tenant_id%8=0 THEN $AS_OF - (tenant_id%60)::INT END AS deactivated_on FROM (SELECT c_custkey AS tenant_id, 'coaching_ai' AS add_on FROM customer WHERE c_custkey%4=0 UNION ALL SELECT c_custkey, 'data_export' FROM customer WHERE c_custkey%6=0 UNION ALL SELECT c_custkey, 'extra_workspace' FROM customer WHERE c_custkey%10=0)""")
oracle("usage_records", f"""SELECT user_id AS tenant_id, {M("event_type", {"click": "ai_insight_credits", "view": "agent_actions", "purchase": "deals", "signup": "seats"}, "api_calls")} AS meter, floor(value)::BIGINT+1 AS quantity, ts - INTERVAL 8058 DAY AS used_at FROM events""")
oracle("ramp_steps", """WITH c AS (SELECT c_custkey AS k, $AS_OF + (c_custkey%40-20)::INT AS t FROM customer) SELECT k AS tenant_id, 1 AS step, (t - INTERVAL 6 MONTHS)::DATE AS start_date, t AS end_date, 'growth' AS plan_code, CASE WHEN k%2=0 THEN 1200.0 END AS price_override FROM c UNION ALL SELECT k, 2, t, (t + INTERVAL 6 MONTHS)::DATE, 'enterprise', CASE WHEN k%4=0 THEN 4200.0 END FROM c""")
_v = lambda x: "NULL" if x is None else (f"'{x}'" if isinstance(x, str) else str(x))
oracle("plan_limits", "SELECT plan_code, meter, included::BIGINT AS included, cap_type, overage_price::DOUBLE AS overage_price FROM (VALUES " + ",".join("(" + ",".join(_v(c) for c in r) + ")" for r in PLAN_LIMITS) + ") t(plan_code, meter, included, cap_type, overage_price)")
PP = "CASE WHEN billing_interval='annual' THEN CASE {p} WHEN 'starter' THEN 4990.0 WHEN 'growth' THEN 14990.0 ELSE 49990.0 END{a} ELSE CASE {p} WHEN 'starter' THEN 499.0 WHEN 'growth' THEN 1499.0 ELSE 4999.0 END{m} END"
MON = PP.format(p="plan_code", a="/12", m="")
oracle("meter_usage", "SELECT tenant_id, meter, strftime(used_at,'%Y-%m') AS period, sum(quantity)::BIGINT AS used, count(*) AS records FROM usage_records GROUP BY 1,2,3")
oracle("quota_enforcement", """
WITH g AS (SELECT tenant_id, meter, sum(more)::BIGINT AS more FROM (SELECT tenant_id, CASE add_on WHEN 'coaching_ai' THEN 'ai_insight_credits' WHEN 'data_export' THEN 'api_calls' END AS meter, CASE add_on WHEN 'coaching_ai' THEN 10000 WHEN 'data_export' THEN 100000 END AS more FROM subscription_add_ons WHERE deactivated_on IS NULL) WHERE meter IS NOT NULL GROUP BY 1,2),
j AS (SELECT s.tenant_id, plan_code, l.meter, cap_type, overage_price, coalesce(used,0) AS used, l.included+coalesce(more,0) AS included, l.included IS NULL AS unlimited FROM subscriptions s JOIN plan_limits l USING (plan_code) LEFT JOIN g ON g.tenant_id=s.tenant_id AND g.meter=l.meter LEFT JOIN (SELECT * FROM meter_usage WHERE period='2001-12') u ON u.tenant_id=s.tenant_id AND u.meter=l.meter)
SELECT *, greatest(0,included-used)::BIGINT AS remaining, coalesce(greatest(0,used-included),0)::BIGINT AS overage, round(coalesce(greatest(0,used-included),0)*coalesce(overage_price,0),6) AS overage_cost, NOT (coalesce(used>=included,false) AND cap_type='hard') AS allowed, coalesce(used+1>included,false) AND cap_type='hard' AS would_exceed_by_one,
 CASE WHEN used>=included AND cap_type='hard' THEN 'limit reached' WHEN used>=included AND cap_type='soft' THEN 'overage charges apply' END AS message FROM (SELECT * REPLACE (CASE WHEN unlimited THEN NULL ELSE included END AS included) FROM j)
""")
oracle("usage_threshold_crossings", """
WITH d AS (SELECT tenant_id, meter, used_at::DATE AS day, sum(quantity)::BIGINT AS q FROM usage_records WHERE strftime(used_at,'%Y-%m')='2001-12' GROUP BY 1,2,3), r AS (SELECT *, (sum(q) OVER (PARTITION BY tenant_id, meter ORDER BY day))::BIGINT AS total FROM d)
SELECT r.tenant_id, r.meter, day, total, included, cap_type, p AS threshold FROM r JOIN quota_enforcement e ON e.tenant_id=r.tenant_id AND e.meter=r.meter, (VALUES (70),(90),(100)) v(p) WHERE NOT unlimited AND included>0 AND total*100>=included*p AND (total-q)*100<included*p
""")
oracle("overage_charges", "SELECT u.tenant_id, period, u.meter, used, included, used-included AS overage, overage_price AS unit_price, round((used-included)*overage_price,6) AS total FROM meter_usage u JOIN subscriptions s USING (tenant_id) JOIN plan_limits l ON l.plan_code=s.plan_code AND l.meter=u.meter WHERE used>included AND overage_price IS NOT NULL")
oracle("invoice_lines", f"""
SELECT tenant_id, type, item, quantity, round(amount,6) AS amount, '2001-12' AS period FROM (SELECT tenant_id, 'subscription' AS type, CASE plan_code WHEN 'starter' THEN 'Starter' WHEN 'growth' THEN 'Growth' ELSE 'Enterprise' END AS item, 1.0 AS quantity, {MON} AS amount FROM subscriptions
UNION ALL SELECT tenant_id, 'addon', CASE add_on WHEN 'coaching_ai' THEN 'Coaching AI' WHEN 'data_export' THEN 'Data Export API' ELSE 'Additional Workspace' END, quantity, CASE add_on WHEN 'coaching_ai' THEN 2000.0 WHEN 'data_export' THEN 150.0 ELSE 300.0*quantity END FROM subscription_add_ons WHERE deactivated_on IS NULL OR deactivated_on >= DATE '2001-12-01'
UNION ALL SELECT tenant_id, 'overage', meter, overage, total FROM overage_charges WHERE period='2001-12')
""")
oracle("invoices", f"""
WITH p AS (SELECT tenant_id, period, {S("amount", None, 6)} AS subtotal, count(*) AS lines FROM invoice_lines GROUP BY 1,2), d AS (SELECT p.*, discount_percent, region, has_tax_id, {RD("subtotal*discount_percent/100", 6)} AS discount_amount, CASE WHEN region='EU' AND has_tax_id THEN 0 ELSE {M("region", {"US": 0, "EU": 20, "UK": 20, "APAC": 10, "LATAM": 16}, 0)} END AS tax_rate FROM p JOIN subscriptions USING (tenant_id)),
t AS (SELECT *, {RD("(subtotal-discount_amount)*tax_rate/100", 6)} AS tax_amount FROM d) SELECT *, {RD("subtotal-discount_amount+tax_amount", 4)} AS total, $AS_OF+30 AS due_date, 'draft' AS status FROM t
""")
Y = lambda p: PP.format(p=p, a="", m="*12")
oracle("plan_change_proration", f"""
WITH m AS (SELECT *, CASE plan_code WHEN 'starter' THEN 'growth' ELSE 'enterprise' END AS new_plan, greatest(contract_end-$AS_OF,0)::INT AS remaining_days FROM subscriptions WHERE plan_code IN ('starter','growth') AND contract_end>$AS_OF)
SELECT tenant_id, remaining_days, 'credit' AS type, plan_code AS plan, {RD("-1.0*(" + Y("plan_code") + ")/365*remaining_days", 4)} AS amount FROM m UNION ALL SELECT tenant_id, remaining_days, 'charge', new_plan, {RD("1.0*(" + Y("new_plan") + ")/365*remaining_days", 4)} FROM m
""")
oracle("ramp_step_in_force", f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY start_date, step) AS rn FROM ramp_steps WHERE start_date<=$AS_OF AND $AS_OF<end_date) WHERE rn=1), b AS (SELECT f.tenant_id, step, f.plan_code, billing_interval, discount_percent, price_override FROM f JOIN subscriptions s USING (tenant_id))
SELECT tenant_id, step, plan_code, base_price_per_month, {RD("base_price_per_month-base_price_per_month*discount_percent/100", 6)} AS contracted_mrr FROM (SELECT *, coalesce(price_override, {MON}) AS base_price_per_month FROM b)
""")
oracle("contract_renewals", f"""
SELECT tenant_id, plan_code, contract_end, (contract_end-$AS_OF)::INT AS days_to_renewal, {L("(contract_end-$AS_OF)", "<", [(0, "lapsed"), (31, "30_days"), (61, "60_days"), (91, "90_days")], "later")} AS reminder, CASE WHEN cancel_at_period_end THEN 'canceled' ELSE 'renewed' END AS status, CASE WHEN NOT cancel_at_period_end THEN (contract_end + INTERVAL 12 MONTHS)::DATE END AS new_contract_end,
 b AS base_price_per_month, {RD("b-b*discount_percent/100", 6)} AS contracted_mrr, discount_percent>20 AS needs_approval, $AS_OF+14 AS quote_expires FROM (SELECT *, {MON} AS b FROM subscriptions)
""")
oracle("upgrade_nudges", f"""
SELECT tenant_id, CASE WHEN used/included>=1 THEN 'limit_reached' ELSE 'limit_approaching' END AS nudge, meter, round((used/included*100)::VARCHAR::DECIMAL(38,18),0)::BIGINT || '% of ' || meter || ' used' AS message FROM quota_enforcement WHERE meter IN ('seats','deals','agent_actions') AND included>0 AND used/included>=0.8
UNION ALL SELECT tenant_id, 'trial_ending', NULL, 'Trial ends in ' || (trial_ends-$AS_OF) || ' days' FROM subscriptions WHERE trial_ends-$AS_OF BETWEEN 0 AND 7
""")
oracle("action_outcomes", f"""SELECT customer_id, count(*) AS total, {N("result='success'")} AS success, {N("result='failed'")} AS failed, {N("result='pending'")} AS pending, {R(N("result='success'"), N("result IN ('success','failed')"), empty=0)} AS success_rate, avg(rating) AS avg_rating, {N("feedback='accepted'")} AS accepted, {N("feedback='rejected'")} AS rejected FROM agent_actions GROUP BY 1""")
oracle("webhook_failure_state", f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY webhook_id ORDER BY created_at, delivery_id) AS rn FROM webhook_deliveries), l AS (SELECT webhook_id, max(rn) FILTER (WHERE status='delivered') AS ok, {N("status='delivered'")} AS success_count, {N("status<>'delivered'")} AS failure_count FROM o GROUP BY 1),
c AS (SELECT l.webhook_id, success_count, failure_count, (SELECT count(*) FROM o WHERE o.webhook_id=l.webhook_id AND o.rn>coalesce(l.ok,0)) AS consecutive_failures FROM l)
SELECT *, {L("consecutive_failures", ">=", [(10, "suspended"), (5, "failing")], "active")} AS status, {R("success_count", "success_count+failure_count", empty=1)} AS success_rate, CASE WHEN consecutive_failures>0 THEN 1000*pow(2.0,consecutive_failures-1) ELSE 0.0 END AS backoff_ms FROM c
""")
_wr = f"""count(*) AS total, {N("status='delivered'")} AS delivered, {N("status='failed'")} AS failed, avg(response_time_ms) AS avg_latency_ms FROM webhook_deliveries"""
oracle("webhook_rollup", f"SELECT *, {R('delivered', 'delivered+failed', empty=1)} AS success_rate FROM (SELECT NULL::BIGINT AS customer_id, NULL::BIGINT AS webhook_id, 'all' AS level, {_wr} UNION ALL SELECT customer_id, NULL, 'tenant', {_wr} GROUP BY 1 UNION ALL SELECT customer_id, webhook_id, 'webhook', {_wr} GROUP BY 1,2)")
oracle("webhook_error_buckets", f"""
WITH b AS (SELECT 'error' AS view, CASE WHEN response_code IS NULL THEN 'connection' WHEN response_code BETWEEN 400 AND 499 THEN 'http_4xx' WHEN response_code BETWEEN 500 AND 599 THEN 'http_5xx' END AS bucket FROM webhook_deliveries UNION ALL SELECT 'latency', {L("response_time_ms", "<", [(100, "<100ms"), (500, "100-500ms"), (1000, "500ms-1s"), (5000, "1-5s")], ">5s")} FROM webhook_deliveries)
SELECT view, bucket, count(*) AS count, round(count(*)*100/sum(count(*)) OVER (PARTITION BY view),4) AS percentage FROM b WHERE bucket IS NOT NULL GROUP BY 1,2
""")
oracle("sync_state", f"""
WITH s AS (SELECT customer_id, source_system, arg_max(status, (last_sync_at, records_synced)) AS last_status, max(last_sync_at) AS last_sync_at, max(last_sync_at) FILTER (WHERE status='success') AS last_success_at FROM sync_log WHERE last_sync_at<{END} GROUP BY 1,2),
h AS (SELECT *, CASE WHEN last_status='success' THEN 'ok' WHEN last_status='warning' THEN 'warning' WHEN datesub('second', last_success_at, last_sync_at)<3600 THEN 'warning' ELSE 'error' END AS state, datesub('second', last_sync_at, {END})/3600 AS hours_since_sync, {M("source_system", {"crm_a": 24, "crm_b": 24, "helpdesk": 48, "warehouse": 168, "chat": 1}, 24)} AS stale_limit_hours FROM s)
SELECT *, hours_since_sync>stale_limit_hours AS is_stale FROM h
""")
oracle("tenant_sync_health", f"SELECT customer_id, CASE max(CASE state WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 0 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'ok' END AS worst_state, count(*) AS systems, {', '.join(N(f'''state='{s}' ''') + f' AS {s}_systems' for s in ('ok', 'warning', 'error'))}, {N('is_stale')} AS stale_systems FROM sync_state GROUP BY 1")
oracle("sync_system_counts", f"SELECT source_system, count(*) AS total, {', '.join(N(f'''state='{s}' ''') + f' AS {s}' for s in ('ok', 'warning', 'error'))} FROM sync_state GROUP BY 1")
oracle("integration_health", f"""
SELECT *, {L("health_score", ">=", [(80, "healthy"), (50, "degraded")], "unhealthy")} AS overall_health FROM (SELECT customer_id, greatest(0,100-coalesce(s,0)-coalesce(a,0))::BIGINT AS health_score FROM (SELECT customer_id, {N("state='error'")}*20+{N("state='warning'")}*10 AS s FROM sync_state GROUP BY 1)
FULL JOIN (SELECT customer_id, {N("severity='critical'")}*15+{N("severity<>'critical'")}*5 AS a FROM active_alerts GROUP BY 1) USING (customer_id))
""")
oracle("notification_channels", f"""
SELECT *, {R("delivered", "total", empty=0)} AS delivery_rate, {R("read", "delivered", empty=0)} AS read_rate, concat_ws('; ', CASE WHEN delivered*100<total*90 THEN 'low delivery rate' END, CASE WHEN p95_seconds>5 THEN 'p95 above 5 s' END) AS issues FROM (SELECT channel, notification_type, count(*) AS total, {N("status IN ('delivered','read')")} AS delivered, {N("status='read'")} AS "read", {N("status='failed'")} AS failed,
 {", ".join(f"quantile_disc(datesub('second', sent_at, delivered_at), {p}) AS p{n}_seconds" for p, n in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))} FROM notification_log GROUP BY 1,2)
""")
oracle("impact_summary", f"SELECT sum(actions_created)::BIGINT AS actions_created, sum(actions_with_decision)::BIGINT AS actions_with_decision, {S('total_expected_impact_amount')} AS expected_impact, {S('total_realized_impact_amount', None, 4)} AS realized_impact, round({S('avg_time_to_decision_days*actions_with_decision', None, 4)}/sum(actions_with_decision),4) AS weighted_time_to_decision FROM impact_tracker")
oracle("metric_rule_alerts", f"""
WITH m AS (SELECT {N("NOT is_closed AND days_since_activity>14")}/greatest({N("NOT is_closed")},1) AS stale_deal_pct, {N("NOT is_closed AND health_category='Critical'")}::DOUBLE AS critical_deal_count, {N("is_won")}/greatest({N("is_closed")},1) AS win_rate, {N("NOT is_closed")}::DOUBLE AS open_deals, {N("NOT is_closed AND owner_id IS NULL")}::DOUBLE AS unowned_deals,
 round({S("amount", "NOT is_closed")}/(SELECT {S("quota_amount")} FROM quotas),6) AS pipeline_coverage FROM deal_health)
{" UNION ALL ".join(f"SELECT '{i}' AS rule_id, '{m}' AS metric_name, {m} AS metric_value, '{op}' AS operator, {t}::DOUBLE AS threshold, '{s}' AS severity, {m} {'=' if op == '==' else op} {t}::DOUBLE AS triggered FROM m" for i, m, op, t, s in METRIC_RULES)}
""")
from quotaloom.operators.billing import PRICE_BOOK  # noqa: E402  (fixed values only)

_d = lambda x: "NULL::DATE" if x is None else f"DATE '{x}'"
oracle("price_book", "SELECT plan_code, region, bm::DOUBLE AS bm, ba::DOUBLE AS ba, vf, vt FROM (VALUES " + ",".join(f"('{p}','{r}',{m},{a},{_d(f)},{_d(t)})" for p, r, m, a, f, t in PRICE_BOOK) + ") t(plan_code, region, bm, ba, vf, vt)")
_b = lambda i: RD(M("plan_code", {"starter": (499.0, 4990.0)[i], "growth": (1499.0, 14990.0)[i]}, (4999.0, 49990.0)[i]) + "*rate", 2)
oracle("tenant_prices", f"""
WITH s AS (SELECT tenant_id, plan_code, billing_interval, region, has_tax_id, {M("region", {"EU": "EUR", "UK": "GBP", "APAC": "SGD", "LATAM": "BRL"}, "USD")} AS currency, {M("region", {"EU": 0.92, "UK": 0.79, "APAC": 1.34, "LATAM": 4.97}, 1.0)} AS rate FROM subscriptions),
p AS (SELECT s.* EXCLUDE (rate), coalesce(bm, {_b(0)}) AS monthly_price, coalesce(ba, {_b(1)}) AS annual_price, bm IS NOT NULL AS from_book, CASE WHEN s.region='EU' AND has_tax_id THEN 0 ELSE {M("s.region", {"EU": 20, "UK": 20, "APAC": 10, "LATAM": 16}, 0)} END AS tax_rate, {M("s.region", {"US": "sales_tax", "EU": "vat", "UK": "vat", "APAC": "gst", "LATAM": "vat"}, "none")} AS tax_type
 FROM s LEFT JOIN (SELECT * FROM price_book WHERE vf<=$AS_OF AND (vt IS NULL OR $AS_OF<=vt)) b USING (plan_code, region)),
t AS (SELECT *, {RD("CASE WHEN billing_interval='annual' THEN annual_price ELSE monthly_price END*tax_rate/100", 2)} AS tax_amount FROM p)
SELECT *, {RD("CASE WHEN billing_interval='annual' THEN annual_price ELSE monthly_price END+tax_amount", 2)} AS total_with_tax FROM t
""")
PERIODS = "SELECT DISTINCT tenant_id, period, strptime(period || '-01', '%Y-%m-%d')::DATE AS ps FROM meter_usage"
oracle("tenant_prices_by_period", f"""
WITH per AS ({PERIODS}),
s AS (SELECT tenant_id, period, ps, plan_code, billing_interval, region, has_tax_id, {M("region", {"EU": "EUR", "UK": "GBP", "APAC": "SGD", "LATAM": "BRL"}, "USD")} AS currency, {M("region", {"EU": 0.92, "UK": 0.79, "APAC": 1.34, "LATAM": 4.97}, 1.0)} AS rate FROM per JOIN subscriptions USING (tenant_id)),
p AS (SELECT s.* EXCLUDE (rate, ps), coalesce(bm, {_b(0)}) AS monthly_price, coalesce(ba, {_b(1)}) AS annual_price, bm IS NOT NULL AS from_book, CASE WHEN s.region='EU' AND has_tax_id THEN 0 ELSE {M("s.region", {"EU": 20, "UK": 20, "APAC": 10, "LATAM": 16}, 0)} END AS tax_rate, {M("s.region", {"US": "sales_tax", "EU": "vat", "UK": "vat", "APAC": "gst", "LATAM": "vat"}, "none")} AS tax_type
 FROM s LEFT JOIN (SELECT plan_code AS bp, region AS br, bm, ba, vf, vt FROM price_book) b ON b.bp = s.plan_code AND b.br = s.region AND vf <= ps AND (vt IS NULL OR ps <= vt)),
t AS (SELECT *, {RD("CASE WHEN billing_interval='annual' THEN annual_price ELSE monthly_price END*tax_rate/100", 2)} AS tax_amount FROM p)
SELECT *, {RD("CASE WHEN billing_interval='annual' THEN annual_price ELSE monthly_price END+tax_amount", 2)} AS total_with_tax FROM t
""")
oracle("invoice_lines_by_period", f"""
WITH per AS ({PERIODS}),
f AS (SELECT per.tenant_id, per.period, r.plan_code AS step_plan, r.price_override, row_number() OVER (PARTITION BY per.tenant_id, per.period ORDER BY r.start_date, r.step) AS rn
 FROM per JOIN ramp_steps r ON r.tenant_id = per.tenant_id AND r.start_date <= per.ps AND per.ps < r.end_date),
b AS (SELECT per.tenant_id, per.period, coalesce(f.step_plan, s.plan_code) AS plan_code, s.billing_interval, f.price_override FROM per JOIN subscriptions s ON s.tenant_id = per.tenant_id
 LEFT JOIN (SELECT * FROM f WHERE rn = 1) f ON f.tenant_id = per.tenant_id AND f.period = per.period)
SELECT tenant_id, period, type, item, quantity, round(amount,6) AS amount FROM (SELECT tenant_id, period, 'subscription' AS type, CASE plan_code WHEN 'starter' THEN 'Starter' WHEN 'growth' THEN 'Growth' ELSE 'Enterprise' END AS item, 1.0 AS quantity, coalesce(price_override, {MON}) AS amount FROM b
UNION ALL SELECT a.tenant_id, per.period, 'addon', CASE add_on WHEN 'coaching_ai' THEN 'Coaching AI' WHEN 'data_export' THEN 'Data Export API' ELSE 'Additional Workspace' END, quantity, CASE add_on WHEN 'coaching_ai' THEN 2000.0 WHEN 'data_export' THEN 150.0 ELSE 300.0*quantity END
 FROM subscription_add_ons a JOIN per ON per.tenant_id = a.tenant_id WHERE deactivated_on IS NULL OR deactivated_on >= per.ps
UNION ALL SELECT tenant_id, period, 'overage', meter, overage, total FROM overage_charges)
""")
oracle("regional_price_list", f"SELECT plan_code, region, currency, max(monthly_price) AS monthly_price, max(annual_price) AS annual_price, count(*) AS tenants, {S('total_with_tax')} AS billed FROM tenant_prices GROUP BY 1,2,3")
oracle("notification_trends", f"""
WITH d AS (SELECT customer_id, summary_date, sum(total_sent) AS sent, sum(total_delivered) AS ok FROM notification_summary GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY summary_date) AS f, row_number() OVER (PARTITION BY customer_id ORDER BY summary_date DESC) AS l FROM d),
g AS (SELECT customer_id, coalesce(sum(sent) FILTER (WHERE f<=7),0)::BIGINT AS older_volume, coalesce(sum(sent) FILTER (WHERE l<=7),0)::BIGINT AS recent_volume, coalesce(sum(ok) FILTER (WHERE f<=7),0) AS o, coalesce(sum(ok) FILTER (WHERE l<=7),0) AS n FROM r GROUP BY 1),
h AS (SELECT customer_id, older_volume, recent_volume, {R("o", "older_volume", empty=0)} AS older_rate, {R("n", "recent_volume", empty=0)} AS recent_rate FROM g)
SELECT *, CASE WHEN recent_rate>older_rate+0.02 THEN 'improving' WHEN recent_rate<older_rate-0.02 THEN 'declining' ELSE 'stable' END AS delivery_rate_trend, CASE WHEN recent_volume>older_volume*1.1 THEN 'increasing' WHEN recent_volume<older_volume*0.9 THEN 'decreasing' ELSE 'stable' END AS volume_trend, CASE WHEN recent_rate<0.95 THEN 'Delivery rate below 95%' END AS issue FROM h
""")
oracle("ops_overview", f"""SELECT * FROM (SELECT count(*) AS queue_items, {N("severity='critical'")} AS critical_items, avg(estimated_resolution_min) AS avg_minutes FROM ops_agent_queue), (SELECT count(*) AS datasets, {N('is_healthy')} AS healthy, {N('is_slow')} AS slow, sum(record_count)::BIGINT AS records FROM build_metrics)""")
from quotaloom.operators.billing import ALERT_RULES  # noqa: E402  (fixed values only)

_pct = lambda x: f"printf('%.1f%%', round({x}*100,1))"
_texts = {
    "stale_pipeline": f"'Pipeline staleness at ' || {_pct('v')} || ', exceeds 10.0% threshold. ' || n_stale || ' deals need attention.'",
    "build_failure": "'Build ' || b.build_id || ' failed for dataset ' || b.dataset_path || '. Error: ' || coalesce(b.error_message,'')",
    "data_quality_drop": f"'Data quality dropped to ' || {_pct('v')} || ', below 90.0% threshold.'",
    "sync_delay": "'CRM sync delayed by ' || printf('%.0f', round(v,0)) || ' minutes (threshold: 60min).'",
    "health_critical": "printf('%.0f', v) || ' deals in critical health status, representing $' || format('{:,}', round(critical_amount,0)::BIGINT) || ' at risk.'",
    "forecast_miss": f"'Forecast variance at ' || {_pct('v')} || ', exceeds 20.0% tolerance.'",
    "quota_at_risk": f"'Projected quota attainment at ' || {_pct('v')} || ', below 80.0% threshold.'",
}
oracle("alert_rule_events", f"""
WITH d AS (SELECT {N("NOT is_closed")} AS n_live, {N("NOT is_closed AND days_since_activity>14")} AS n_stale, {N("NOT is_closed AND health_category='Critical'")} AS n_critical, {S("amount", "NOT is_closed AND health_category='Critical'")} AS critical_amount,
 {S("amount", "close_date BETWEEN DATE '2001-10-01' AND DATE '2001-12-31' AND (is_won OR (NOT is_closed AND forecast_category='Commit'))")} AS projected FROM deal_health),
f AS (SELECT * FROM build_log WHERE status='FAILED' AND build_timestamp > DATE '2001-12-31' AND build_timestamp < DATE '2002-01-01'),
b AS (SELECT count(*) AS n_failed, min(build_id) AS build_id, (SELECT dataset_path FROM f ORDER BY build_id LIMIT 1) AS dataset_path, (SELECT error_message FROM f ORDER BY build_id LIMIT 1) AS error_message FROM f),
m AS (SELECT d.*, b.*, (SELECT overall_score FROM data_quality_summary) AS quality, (SELECT max(datesub('second', last_success_at, TIMESTAMP '2002-01-01')/60) FROM sync_state) AS delay,
 (SELECT max(1-avg_accuracy) FROM forecast_accuracy WHERE recommended) AS missed, (SELECT {S("quota_amount")} FROM quotas) AS quota FROM d, b)
{" UNION ALL ".join(f"SELECT '{a}' AS alert_type, '{metric}' AS metric_name, v AS metric_value, '{op}' AS operator, {t}::DOUBLE AS threshold, '{sev}' AS severity, '{title}' AS title, coalesce(v {'=' if op == '==' else op} {t}::DOUBLE, false) AS triggered, CASE WHEN v {'=' if op == '==' else op} {t}::DOUBLE THEN {_texts[a]} END AS message FROM (SELECT *, round(({e})::DOUBLE,6) AS v FROM m) b"
  for (a, metric, op, t, sev, title, _), e in zip(ALERT_RULES, ("n_stale/greatest(n_live,1)", "CASE WHEN n_failed>0 THEN 1 ELSE 0 END", "quality", "delay", "n_critical", "missed", "projected/nullif(quota,0)")))}
""")

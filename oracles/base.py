"""Canonical entities over the driver tables."""

from oracles import L, M, oracle

SEGMENT = M("c_mktsegment", {"AUTOMOBILE": "Enterprise", "MACHINERY": "Enterprise", "BUILDING": "Mid-Market", "FURNITURE": "Mid-Market"}, "SMB")
INDUSTRY = M("c_mktsegment", {"AUTOMOBILE": "Manufacturing", "MACHINERY": "Technology", "BUILDING": "Financial Services", "FURNITURE": "Retail"}, "Healthcare")

oracle("stage_benchmarks", """
SELECT stage_name, expected_days::INT AS expected_days, most::INT AS max_acceptable_days, conv::DOUBLE AS historical_conversion_rate,
 n::INT AS stage_order, n <= 6 AS is_sales_stage, n > 6 AS is_admin_stage,
 floor(expected_days*1.5)::INT AS stall_threshold_days, (expected_days*2)::INT AS critical_threshold_days
FROM (VALUES ('Prospecting',7,14,0.80,1),('Discovery',14,21,0.70,2),('Solution Design',21,35,0.65,3),('Proposal',10,18,0.60,4),
 ('Negotiation',14,28,0.75,5),('Verbal Commit',5,10,0.90,6),('Legal Review',5,10,0.95,7),('Security Review',3,7,0.98,8),('Procurement',7,14,0.95,9))
 t(stage_name, expected_days, most, conv, n)
""")

oracle("deal_signals", """
SELECT a.*, b.competitor_mentioned FROM (
 SELECT l_orderkey AS opportunity_id, min(l_suppkey) AS owner_id, count(DISTINCT l_suppkey)::INT AS stakeholder_count,
  round(sum(round(l_discount*100)::BIGINT)*3.0/count(*),1) AS discount_percent, max(l_shipdate) AS last_ship, min(l_linestatus)='F' AS has_champion
 FROM lineitem GROUP BY 1) a
LEFT JOIN (SELECT l_orderkey AS opportunity_id, min(p_brand) AS competitor_mentioned FROM lineitem JOIN part ON l_partkey=p_partkey
 WHERE l_returnflag='R' GROUP BY 1) b USING (opportunity_id)
""")

oracle("opportunities", f"""
WITH o AS (
 SELECT o_orderkey AS opportunity_id, o_custkey AS account_id, 'Deal ' || o_orderkey AS opportunity_name, o_totalprice AS amount,
  CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey%3=0 THEN 'Closed Lost' ELSE 'Closed Won' END
   WHEN 'P' THEN CASE WHEN o_orderkey%2=0 THEN 'Negotiation' ELSE 'Verbal Commit' END
   ELSE CASE left(o_orderpriority,1) WHEN '1' THEN 'Proposal' WHEN '2' THEN 'Solution Design' WHEN '4' THEN 'Prospecting' ELSE 'Discovery' END END AS stage_name,
  o_orderstatus='F' AS is_closed, o_orderdate::DATE AS d, ($AS_OF - o_orderdate::DATE)::INT AS a
 FROM orders),
c AS (SELECT c_custkey AS account_id, c_name AS account_name, {SEGMENT} AS segment, {INDUSTRY} AS industry, r_name AS region
 FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey),
x AS (SELECT o.*, c.* EXCLUDE (account_id), s.* EXCLUDE (opportunity_id),
  CASE WHEN is_closed THEN d ELSE $AS_OF - (30 + a%180)::INT END AS created_date,
  CASE WHEN is_closed THEN d + (30 + o.opportunity_id%120)::INT ELSE $AS_OF + (o.opportunity_id%180 - 60)::INT END AS close_date
 FROM o LEFT JOIN c USING (account_id) LEFT JOIN deal_signals s USING (opportunity_id))
SELECT x.* EXCLUDE (d, a, last_ship),
 stage_name='Closed Won' AS is_won,
 CASE stage_name WHEN 'Closed Won' THEN 'Closed' WHEN 'Closed Lost' THEN 'Omitted' WHEN 'Verbal Commit' THEN 'Commit'
  WHEN 'Negotiation' THEN 'Best Case' WHEN 'Proposal' THEN 'Best Case' ELSE 'Pipeline' END AS forecast_category,
 (CASE stage_name WHEN 'Prospecting' THEN 10 WHEN 'Discovery' THEN 20 WHEN 'Solution Design' THEN 40 WHEN 'Proposal' THEN 60
  WHEN 'Negotiation' THEN 75 WHEN 'Verbal Commit' THEN 90 WHEN 'Closed Won' THEN 100 ELSE 0 END)::DOUBLE AS win_probability,
 CASE WHEN is_closed THEN 0 ELSE a%60 END::INT AS days_in_current_stage,
 $AS_OF - (($AS_OF - last_ship::DATE)%45)::INT AS last_activity_date,
 competitor_mentioned IS NOT NULL AS is_competitive,
 'Rep ' || owner_id AS owner_name, owner_id%8 AS manager_id, 'Manager ' || (owner_id%8) AS manager_name,
 CASE WHEN opportunity_id%4<>0 THEN 'Follow up' END AS next_step,
 CASE WHEN stage_name='Closed Lost' THEN CASE opportunity_id%5 WHEN 0 THEN 'Price' WHEN 1 THEN 'Product Gap' WHEN 2 THEN 'No Decision' WHEN 3 THEN 'Competitor' ELSE 'Timing' END END AS loss_reason,
 CASE opportunity_id%4 WHEN 0 THEN 'Inbound' WHEN 1 THEN 'Outbound' WHEN 2 THEN 'Partner' ELSE 'Event' END AS lead_source,
 CASE WHEN opportunity_id%2=0 THEN 'New Business' ELSE 'Expansion' END AS deal_type,
 'Product ' || (opportunity_id%6) AS product,
 opportunity_id%100=7 AS is_hero_deal,
 CASE WHEN opportunity_id%50=0 THEN 20+opportunity_id%79 END::INT AS health_score_override,
 (CASE stage_name WHEN 'Prospecting' THEN 10 WHEN 'Discovery' THEN 20 WHEN 'Solution Design' THEN 40 WHEN 'Proposal' THEN 60
  WHEN 'Negotiation' THEN 75 WHEN 'Verbal Commit' THEN 90 WHEN 'Closed Won' THEN 100 ELSE 0 END)::DOUBLE / 100 AS probability,
 (CASE WHEN is_closed THEN close_date - created_date ELSE close_date - $AS_OF END)::INT AS days_to_close
FROM x
""")

oracle("sales_reps", """
SELECT s_suppkey AS rep_id, 'Rep ' || s_suppkey AS rep_name, s_suppkey%8 AS manager_id, 'Manager ' || (s_suppkey%8) AS manager_name,
 r_name AS region, CASE s_suppkey%3 WHEN 0 THEN 'Enterprise' WHEN 1 THEN 'Mid-Market' ELSE 'SMB' END AS segment,
 $AS_OF - (20 + (37*s_suppkey)%1500)::INT AS start_date, ((20 + (37*s_suppkey)%1500)//30)::INT AS tenure_months,
 (1+s_suppkey%10)*1000000.0 AS quota, (1+s_suppkey%10)*1000000.0 AS annual_quota, (1+s_suppkey%10)*1000000.0/4 AS quarterly_quota,
 round((1+s_suppkey%10)*1000000.0*((40+(s_suppkey*37)%100)/100),2) AS ytd_closed_revenue,
 round((1+s_suppkey%10)*1000000.0*((40+(s_suppkey*37)%100)/100)/4,2) AS q4_closed_revenue,
 (40+(s_suppkey*37)%100)/100 AS ytd_attainment, (15+(s_suppkey*13)%40)/100 AS win_rate,
 (50000+(s_suppkey*7001)%200000)::DOUBLE AS avg_deal_size, (30+(s_suppkey*11)%90)::INT AS avg_sales_cycle_days,
 (10+(s_suppkey*7)%40)/10 AS avg_stakeholders, (5+(s_suppkey*3)%30)::INT AS deals_in_pipeline,
 (20+(s_suppkey*17)%80)::INT AS activities_this_month, (10+(s_suppkey*19)%40)/10 AS pipeline_coverage, round((1+s_suppkey%10)*1000000.0/4*(10+(s_suppkey*19)%40)/10,2) AS current_pipeline,
 'rep' || s_suppkey || '@sales.example' AS email, CASE WHEN s_suppkey%4=0 THEN 'Senior AE' ELSE 'AE' END AS role, (40+(s_suppkey%5)*40)::INT AS max_deals
FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey
""")

oracle("quotas", "SELECT rep_id, quarterly_quota AS quota_amount FROM sales_reps")

oracle("accounts", f"""
SELECT c_custkey AS account_id, c_name AS account_name, {SEGMENT} AS segment, {INDUSTRY} AS industry, r_name AS region, n_name AS territory,
 (c_custkey*7919)%2000*100000.0 AS annual_revenue, ((c_custkey*31)%2500)::INT AS employee_count,
 round(greatest(c_acctbal,0)*10,2) AS current_arr, (20+c_custkey%80)::INT AS health_score, c_custkey//15 AS owner_id,
 $AS_OF - (30+(c_custkey*53)%2000)::INT AS created_date, $AS_OF + ((c_custkey*29)%365)::INT AS renewal_date,
 lower(replace(c_name,'#','')) || '.example' AS domain
FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey
""")

oracle("activities", f"""
SELECT event_id AS activity_id, {M("event_type", {"click": "Email", "view": "Call", "purchase": "Meeting", "signup": "Demo"}, "Task")} AS activity_type,
 upper(event_type[1]) || event_type[2:] || ' touch' AS subject, event_id//3 AS opportunity_id, user_id AS account_id, user_id AS owner_id,
 event_id%5 AS contact_id, ts::DATE - 8058 AS activity_date, floor(value)::INT AS duration_minutes, ts::DATE - 8058 <= $AS_OF AS is_completed
FROM events
""")

oracle("process_events", f"""
SELECT event_id, case_id, activity, timestamp, resource, amount, duration_days, benchmark_days,
 (duration_days - benchmark_days)::INT AS deviation_days, coalesce(duration_days > benchmark_days*1.5, false) AS is_bottleneck,
 timestamp > first_seen AS is_rework
FROM (SELECT event_id, user_id AS case_id, activity, ts AS timestamp, 'Team ' || (event_id%5) AS resource, round(value*1000,2) AS amount,
  floor((epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-01-31')) - epoch_us(ts))/3600000000)::INT AS duration_days,
  min(ts) OVER (PARTITION BY user_id, activity) AS first_seen
 FROM (SELECT *, {M("event_type", {"click": "Discovery", "view": "Proposal", "purchase": "Negotiation", "signup": "Legal Review"}, "Security Review")} AS activity FROM events))
LEFT JOIN (SELECT stage_name AS activity, expected_days AS benchmark_days FROM stage_benchmarks) USING (activity)
""")

oracle("leads", """
SELECT event_id AS lead_id, user_id, CASE event_id%4 WHEN 0 THEN 'Inbound' WHEN 1 THEN 'Outbound' WHEN 2 THEN 'Partner' ELSE 'Event' END AS lead_source,
 CASE user_id%3 WHEN 0 THEN 'Enterprise' WHEN 1 THEN 'Mid-Market' ELSE 'SMB' END AS segment,
 CASE event_id%7 WHEN 0 THEN 'MQL' WHEN 1 THEN 'MQL' WHEN 2 THEN 'SQL' WHEN 3 THEN 'Qualified' WHEN 4 THEN 'Converted' WHEN 5 THEN 'Disqualified' ELSE 'New' END AS status,
 least(floor(value)::INT,100)::INT AS lead_score, ts AS created_date, nxt AS first_response_date
FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type='signup'
""")
oracle("lead_touches", f"""
SELECT lead_id, l.user_id, first_response_date AS activity_date, {M("event_type", {"click": "Email", "view": "Call", "purchase": "Meeting", "signup": "Demo"}, "Task")} AS activity_type
FROM leads l JOIN events e ON e.user_id=l.user_id AND e.ts=l.first_response_date
""")
oracle("contacts", "SELECT c_custkey AS contact_id, c_custkey AS account_id, 'First' || (c_custkey%20) AS first_name, 'Last' || (c_custkey%50) AS last_name, 'c' || (c_custkey%400) || '@mail.example' AS email, c_custkey%3<>0 AS is_primary FROM customer")
oracle("product_events", f"""SELECT user_id AS account_id, event_id%7 AS user_id, {M("event_type", {"click": "core_click", "view": "core_view", "purchase": "premium_purchase", "signup": "signup"}, "error")} AS event_name, ts - INTERVAL 8058 DAY AS event_timestamp FROM events""")
oracle("tickets_raw", """
SELECT event_id AS id, user_id AS organization_id, 'u' || (event_id%9) || '@' || CASE WHEN event_id%3=0 THEN 'customer' || lpad(user_id::VARCHAR,9,'0') || '.example' ELSE 'other.example' END AS requester_email, 'Ticket ' || event_id AS subject,
 CASE event_id%4 WHEN 0 THEN 'open' WHEN 1 THEN 'pending' WHEN 2 THEN 'solved' ELSE 'closed' END AS status, CASE WHEN value>100 THEN 'urgent' WHEN value>50 THEN 'high' WHEN value>20 THEN 'normal' ELSE 'low' END AS priority,
 ts - INTERVAL 8058 DAY AS created_at, CASE WHEN event_id%4>=2 THEN nxt - INTERVAL 8058 DAY END AS solved_at, CASE WHEN event_id%4>=2 THEN 1+event_id%5 END::INT AS satisfaction_rating
FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type='error'
""")
oracle("account_domains", "SELECT domain, account_id FROM accounts")
oracle("marketing_raw", """SELECT event_id AS id, user_id AS "leadId", (event_id%12)::INT AS "activityTypeId", ts - INTERVAL 8058 DAY AS "activityDate", event_id%8 AS "campaignId", 'Asset ' || (event_id%15) AS "primaryAttributeValue" FROM events WHERE event_type IN ('click','view')""")
oracle("sales_interventions", """
SELECT 'DEC-' || o_orderkey AS decision_id, $AS_OF + (o_orderkey%10)::INT AS decision_date, CASE o_orderkey%4 WHEN 0 THEN 'Rep' WHEN 1 THEN 'Manager' WHEN 2 THEN 'VP' END AS actor_role, o_orderkey AS opportunity_id, 'ACT-' || o_orderkey AS action_id,
 CASE o_orderkey%5 WHEN 0 THEN 'Accept' WHEN 1 THEN 'Override' WHEN 2 THEN 'Defer' WHEN 3 THEN 'Escalate' END AS decision_type, (30+o_orderkey%40)::INT AS pre_health_score, (30+o_orderkey%40+o_orderkey%30-5)::INT AS post_health_score,
 o_totalprice*0.5 AS expected_impact_amount, o_totalprice*(o_orderkey%4)*0.25 AS realized_impact_amount, CASE o_orderkey%7 WHEN 0 THEN 'Won' WHEN 1 THEN 'Lost' WHEN 2 THEN 'Slip' ELSE 'Open' END AS result, CASE WHEN o_orderkey%11<>0 THEN 'Q4 2001' END AS quarter
FROM orders WHERE o_orderstatus<>'F'
""")

from oracles import L, M, N, RD, oracle

D0 = "DATE '1970-01-01'"
_ms = lambda d: f"(({d} - {D0})::BIGINT * 86400000)"
_dt = lambda m: f"({D0} + ({m}//86400000)::INT)"
_ts = lambda m: f"epoch_ms({m})"
SH = "(ts - INTERVAL 8058 DAY)::DATE"
STAGE = "CASE o_orderkey%6 WHEN 0 THEN 'Prospecting' WHEN 1 THEN 'Discovery' WHEN 2 THEN 'Proposal' WHEN 3 THEN 'Negotiation' WHEN 4 THEN 'Closed Won' ELSE 'Closed Lost' END"
oracle("crm_user", "SELECT s_suppkey AS owner_id, 'Rep ' || CASE s_suppkey%3 WHEN 0 THEN 'West ' WHEN 1 THEN 'East ' ELSE '' END || s_suppkey AS owner_name FROM supplier")
oracle("staging_opportunities", f"""
SELECT *, {L("amount", ">=", [(500000, "Enterprise"), (100000, "Mid-Market"), (25000, "SMB")], "Velocity")} AS segment, CASE WHEN owner_name LIKE '%West%' THEN 'West' WHEN owner_name LIKE '%East%' THEN 'East' ELSE 'Central' END AS region
FROM (SELECT o_orderkey AS opportunity_id, 'Deal ' || o_orderkey AS opportunity_name, o_custkey AS account_id, o_custkey//15 AS owner_id, o_totalprice AS amount, {STAGE} AS stage_name, o_orderdate::DATE + (30+o_orderkey%90)::INT AS close_date, o_orderdate::DATE AS created_date,
 o_orderdate::DATE + (o_orderkey%30)::INT AS last_modified_date, CASE o_orderkey%4 WHEN 0 THEN 'Inbound' WHEN 1 THEN 'Outbound' WHEN 2 THEN 'Partner' ELSE 'Event' END AS lead_source, o_orderkey%6>=4 AS is_closed, o_orderkey%6=4 AS is_won FROM orders)
LEFT JOIN (SELECT c_custkey AS account_id, c_name AS account_name FROM customer) USING (account_id) LEFT JOIN crm_user USING (owner_id)
""")
SEG = "CASE WHEN annual_revenue>=100000000 OR employee_count>=1000 THEN 'Enterprise' WHEN annual_revenue>=10000000 OR employee_count>=100 THEN 'Mid-Market' ELSE 'SMB' END"
oracle("staging_accounts", f"""
SELECT *, {SEG} AS segment FROM (SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS industry, (c_custkey*7919)%2000*100000.0 AS annual_revenue, ((c_custkey*31)%2500)::INT AS employee_count, 'https://' || lower(replace(c_name,'#','')) || '.example' AS website, c_custkey//15 AS owner_id FROM customer) LEFT JOIN crm_user USING (owner_id)
""")
oracle("staging_contacts", """SELECT c_custkey AS contact_id, 'First' || (c_custkey%20) AS first_name, 'Last' || (c_custkey%50) AS last_name, 'c' || (c_custkey%400) || '@mail.example' AS email, '+1-555-' || lpad(c_custkey::VARCHAR,7,'0') AS phone, CASE c_custkey%3 WHEN 0 THEN 'CEO' WHEN 1 THEN 'CTO' ELSE 'Buyer' END AS title,
 CASE WHEN c_custkey%2=0 THEN 'IT' ELSE 'Finance' END AS department, c_custkey AS account_id, c_custkey//15 AS owner_id, 'Inbound' AS lead_source, false AS is_primary FROM customer""")
oracle("staging_activities", f"""
SELECT * FROM (SELECT event_id AS activity_id, CASE event_type WHEN 'click' THEN 'Email' WHEN 'view' THEN 'Call' ELSE 'Task' END AS activity_type, 'Task ' || event_id AS subject, props AS description, {SH} AS activity_date, {RD("CASE WHEN event_type='view' THEN floor(value*60) END/60", 2)} AS duration_minutes, user_id AS owner_id, user_id AS account_id,
 event_id//3 AS opportunity_id, event_id%5 AS contact_id, CASE WHEN event_id%4=0 THEN 'Open' ELSE 'Completed' END AS status, 'Normal' AS priority, event_id%4<>0 AS is_completed, {SH} AS created_date FROM events WHERE event_type IN ('click','view','error')
UNION ALL SELECT event_id, CASE WHEN event_type='signup' THEN 'Demo' ELSE 'Meeting' END, CASE WHEN event_type='signup' THEN 'Product Demo' ELSE 'Review' END, props, {SH}, floor(value), user_id, user_id, event_id//3, event_id%5, 'Completed', 'Normal', true, {SH} FROM events WHERE event_type IN ('purchase','signup')) LEFT JOIN crm_user USING (owner_id)
""")
oracle("staging_opportunities_incremental", f"""
WITH f AS (SELECT opportunity_id, opportunity_name, amount, stage_name, last_modified_date FROM staging_opportunities), s AS (SELECT * FROM f WHERE last_modified_date <= DATE '2000-12-31'),
n AS (SELECT opportunity_id, opportunity_name, CASE WHEN opportunity_id%10=5 THEN amount+1000 ELSE amount END AS amount, CASE WHEN opportunity_id%10=5 THEN 'Negotiation' ELSE stage_name END AS stage_name, CASE WHEN opportunity_id%10=5 THEN last_modified_date+3000 ELSE last_modified_date END AS last_modified_date FROM f),
x AS (SELECT * FROM n WHERE last_modified_date > (SELECT max(last_modified_date) FROM s))
SELECT * FROM x UNION ALL SELECT * FROM s WHERE opportunity_id NOT IN (SELECT opportunity_id FROM x)
""")
oracle("synced_deals", """
WITH f AS (SELECT account_id AS customer_id, opportunity_id AS deal_id, amount, stage_name, last_modified_date FROM staging_opportunities), s AS (SELECT *, $AS_OF - 365 AS synced_at FROM f WHERE last_modified_date <= $AS_OF - 365),
x AS (SELECT customer_id, deal_id, CASE WHEN deal_id%10=5 THEN amount+1000 ELSE amount END AS amount, CASE WHEN deal_id%10=5 THEN 'Negotiation' ELSE stage_name END AS stage_name, CASE WHEN deal_id%10=5 THEN last_modified_date+3000 ELSE last_modified_date END AS last_modified_date, $AS_OF AS synced_at FROM f),
y AS (SELECT * FROM x WHERE last_modified_date > (SELECT max(last_modified_date) FROM s))
SELECT * FROM y UNION ALL SELECT * FROM s WHERE (customer_id, deal_id) NOT IN (SELECT (customer_id, deal_id) FROM y)
""")
OWN = "LEFT JOIN (SELECT s_suppkey AS owner_id, 'Rep ' || s_suppkey AS owner_name FROM supplier) w USING (owner_id)"
CODE = {0: "Discovery", 1: "Solution Design", 2: "Proposal", 3: "Negotiation", 4: "Verbal Commit", 5: "Closed Won", 6: "Closed Lost"}
oracle("staging_b_opportunities", f"""
SELECT *, {M("stage_name", {"Verbal Commit": "Commit", "Negotiation": "Best Case", "Proposal": "Best Case", "Closed Won": "Closed", "Closed Lost": "Omitted"}, "Pipeline")} AS forecast_category, stage_name IN ('Closed Won','Closed Lost') AS is_closed, stage_name='Closed Won' AS is_won,
 {L("amount", ">=", [(500000, "Enterprise"), (100000, "Mid-Market")], "SMB")} AS segment, 'CRM B' AS source_system
FROM (SELECT o_orderkey AS opportunity_id, 'Deal ' || o_orderkey AS opportunity_name, CASE WHEN o_orderkey%20<>0 THEN o_custkey END AS account_id, o_custkey//15 AS owner_id, o_totalprice AS amount, {M("o_orderkey%8", CODE, "Prospecting")} AS stage_name, o_orderdate::DATE+60 AS close_date, o_orderdate::DATE AS created_date, 'default' AS pipeline,
 {_ts(_ms("o_orderdate::DATE") + " + (o_orderkey%86400)*1000")} AS last_modified_date FROM orders) LEFT JOIN (SELECT c_custkey AS account_id, c_name AS account_name FROM customer) USING (account_id) {OWN}
""")
MADE = f"({_ms("DATE '1999-01-01'")} + (c_custkey%1000)*86400000)"
oracle("staging_b_accounts", f"""
SELECT *, {SEG} AS segment, 'CRM B' AS source_system FROM (SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS industry, ((c_custkey*7919)%2000*100000)::DOUBLE AS annual_revenue, ((c_custkey*31)%2500)::INT AS employee_count, c_custkey//15 AS owner_id, lower(replace(c_name,'#','')) || '.example' AS website,
 {_dt(MADE)} AS created_date, {_ts(MADE + " + 3600000")} AS last_modified_date FROM customer) {OWN}
""")
AT = f"({_ms(SH)} + (event_id%86400)*1000)"
oracle("staging_b_activities", f"""
SELECT *, 'CRM B' AS source_system FROM (SELECT event_id AS activity_id, CASE event_type WHEN 'click' THEN 'Email' WHEN 'view' THEN 'Call' WHEN 'purchase' THEN 'Meeting' WHEN 'signup' THEN 'Note' ELSE 'Task' END AS activity_type, 'Touch ' || event_id AS subject, props AS description, {_dt(AT)} AS activity_date,
 round(CASE WHEN event_type='view' THEN floor(value*1000)*60 END/60000,0)::INT AS duration_minutes, user_id AS owner_id, CASE WHEN event_id%10<>0 THEN user_id END AS account_id, CASE WHEN event_id%10<>0 THEN event_id//3 END AS opportunity_id, CASE WHEN event_id%10<>0 THEN event_id%5 END AS contact_id,
 'Completed' AS status, true AS is_completed, {_ts(AT)} AS created_date FROM events) {OWN}
""")
ADD = f"({_ms("DATE '2000-01-01'")} + (c_custkey%500)*86400000)"
oracle("staging_b_contacts", f"""
SELECT *, 'CRM B' AS source_system FROM (SELECT c_custkey AS contact_id, 'c' || (c_custkey%400) || '@mail.example' AS email, 'First' || (c_custkey%20) AS first_name, 'Last' || (c_custkey%50) AS last_name, CASE c_custkey%3 WHEN 0 THEN 'CEO' WHEN 1 THEN 'CTO' ELSE 'Buyer' END AS job_title, c_custkey//15 AS owner_id,
 CASE WHEN c_custkey%4=0 THEN 'customer' ELSE 'lead' END AS lifecycle_stage, c_custkey AS company_id, {_dt(ADD)} AS created_date, {_ts(f"coalesce(CASE WHEN c_custkey%5<>0 THEN {ADD}+5000 END, {ADD})")} AS last_modified_date, c_name AS company_name FROM customer) {OWN}
""")
oracle("staging_marketing_activities", f"""SELECT event_id, 'Email Campaign' AS activity_type, event_id%8 AS campaign_id, 'c' || (event_id%400) || '@mail.example' AS contact_email, et AS event_type, {_ts(AT)} AS event_timestamp, 77 AS portal_id, et IN ('OPEN','CLICK') AS is_engagement, 'CRM B' AS source_system
FROM (SELECT *, CASE event_id%5 WHEN 0 THEN 'SENT' WHEN 1 THEN 'DELIVERED' WHEN 2 THEN 'OPEN' WHEN 3 THEN 'CLICK' ELSE 'BOUNCE' END AS et FROM events WHERE event_type='click')""")
MERGED = lambda a, b, name, key, cols: f"""
WITH a AS (SELECT lower(trim({name})) AS match_name, {cols}, 'CRM A' AS source FROM {a}), b AS (SELECT lower(trim({name})) AS match_name, {cols}, 'CRM B' AS source FROM {b})
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE {" AND ".join(f"a.{k} = b.{k}" for k in key)})
"""  # noqa: E731
oracle("merged_opportunities", MERGED("staging_opportunities", "staging_b_opportunities", "opportunity_name", ["match_name", "account_id"], "opportunity_id, account_id, amount, stage_name, close_date"))
oracle("merged_accounts", MERGED("staging_accounts", "staging_b_accounts", "account_name", ["match_name"], "account_id, industry, annual_revenue, employee_count, segment"))
oracle("masked_contacts", """SELECT contact_id, account_id, title, department, sha256(lower(email)) AS email_hash, '***' || substr(email, strpos(email,'@')) AS email_masked, '+1-555-***' || right(phone,4) AS phone_masked, left(first_name,1) || '. ' || left(last_name,1) || '.' AS name_masked FROM staging_contacts""")
oracle("recent_product_events", "SELECT * FROM product_events WHERE event_timestamp >= ($AS_OF - 30)::TIMESTAMP AND event_timestamp < ($AS_OF + 1)::TIMESTAMP")
oracle("contact_rule_violations", f"""
SELECT 'duplicate_email' AS rule, account_id, count(*) AS violations FROM (SELECT account_id, email FROM contacts GROUP BY 1,2 HAVING count(*)>1) GROUP BY 2
UNION ALL SELECT 'many_primary', account_id, {N("is_primary")}-1 FROM contacts GROUP BY 2 HAVING {N("is_primary")}>1
UNION ALL SELECT 'no_contact', account_id, 1 FROM accounts WHERE account_id NOT IN (SELECT account_id FROM contacts)
UNION ALL SELECT 'no_primary', account_id, 1 FROM contacts GROUP BY 2 HAVING {N("is_primary")}=0
""")
RULES = [("opportunities", "close_more_than_2y_past", "NOT is_closed AND close_date < $AS_OF - INTERVAL 24 MONTHS"), ("opportunities", "amount_over_100m", "amount>100000000"), ("opportunities", "won_without_amount", "is_won AND coalesce(amount,0)<=0"),
         ("opportunities", "close_before_created", "close_date<created_date"), ("opportunities", "owner_missing", "owner_id IS NULL"), ("activities", "completed_in_future", "is_completed AND activity_date>$AS_OF"), ("activities", "meeting_without_duration", "activity_type='Meeting' AND coalesce(duration_minutes,0)<=0")]
oracle("record_rule_violations", " UNION ALL ".join(f"""SELECT '{t}' AS "table", '{r}' AS rule, count(*) AS "rows", {N(w)} AS violations FROM {t}""" for t, r, w in RULES))
oracle("crm_b_match_names", "SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN 'custome' || substr(lower(c_name),9) WHEN c_custkey%7=0 THEN 'other ' || c_custkey ELSE lower(c_name) END AS name, CASE WHEN c_custkey%2=0 THEN lower(replace(c_name,'#','')) || '.example' END AS domain, CASE WHEN c_custkey%5=0 THEN c_custkey END AS manual_id FROM customer")
oracle("account_matches", """
WITH c AS (SELECT * FROM crm_b_match_names),
n AS (SELECT id, account_id AS name_id, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, account_id) AS rn FROM (SELECT id, account_id, 1-levenshtein(name, lower(account_name))/greatest(length(name), length(account_name)) AS sim FROM c, accounts) WHERE sim>0.9)
SELECT c.id AS company_id, CASE WHEN d.account_id IS NOT NULL THEN 'domain' WHEN name_id IS NOT NULL THEN 'name' WHEN manual_id IS NOT NULL THEN 'manual' ELSE 'none' END AS matched_by, coalesce(d.account_id, name_id, manual_id) AS account_id, round(sim,6) AS similarity
FROM c LEFT JOIN accounts d ON d.domain=c.domain LEFT JOIN (SELECT * FROM n WHERE rn=1) n ON n.id=c.id
""")

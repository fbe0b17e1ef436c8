"""Canonical revenue entities derived from the order, line-item and event tables.

Closed deals keep their real dates.  Open deals are folded into a recent window
so that every age band occurs.  Every derivation is a deterministic expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.dims import STAGE_BENCHMARKS
from quotaloom.functions.exprs import by_value, cases, nvl
from quotaloom.functions.ordered import next_time
from quotaloom.plans.registry import job

EVENT_SHIFT_DAYS = 8058
EVENT_CLOCK_END = "2024-01-31 00:00:00"
SEGMENTS = {
    "AUTOMOBILE": "Enterprise",
    "MACHINERY": "Enterprise",
    "BUILDING": "Mid-Market",
    "FURNITURE": "Mid-Market",
}
INDUSTRIES = {
    "AUTOMOBILE": "Manufacturing",
    "MACHINERY": "Technology",
    "BUILDING": "Financial Services",
    "FURNITURE": "Retail",
}
ACTIVITY_TYPES = {"click": "Email", "view": "Call", "purchase": "Meeting", "signup": "Demo"}
PROCESS_STEPS = {"click": "Discovery", "view": "Proposal", "purchase": "Negotiation", "signup": "Legal Review"}
WIN_PERCENT = {"Prospecting": 10, "Discovery": 20, "Solution Design": 40, "Proposal": 60, "Negotiation": 75, "Verbal Commit": 90, "Closed Won": 100}
FORECAST_CATEGORY = {
    "Closed Won": "Closed",
    "Closed Lost": "Omitted",
    "Verbal Commit": "Commit",
    "Negotiation": "Best Case",
    "Proposal": "Best Case",
}


@job
def stage_benchmarks(spark: SparkSession) -> DataFrame:
    rows = [
        (stage, days, most, conv, n, n <= 6, n > 6, int(days * 1.5), days * 2)
        for stage, days, most, conv, n in STAGE_BENCHMARKS
    ]
    return F.broadcast(
        spark.createDataFrame(
            rows,
            "stage_name string, expected_days int, max_acceptable_days int, historical_conversion_rate double, "
            "stage_order int, is_sales_stage boolean, is_admin_stage boolean, stall_threshold_days int, critical_threshold_days int",
        )
    )


@job
def deal_signals(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Per deal: owner, buying-group size, discount, last touch, champion, competitor.

    The champion flag is a boolean aggregate: a minimum over the status text
    would turn the whole aggregation into a sort.
    """
    per_order = lineitem.groupBy(F.col("l_orderkey").alias("opportunity_id")).agg(
        F.min("l_suppkey").alias("owner_id"),
        F.count_distinct("l_suppkey").cast("int").alias("stakeholder_count"),
        F.round(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) * 3.0 / F.count("*"), 1).alias("discount_percent"),
        F.max("l_shipdate").alias("last_ship"),
        F.bool_or(F.col("l_linestatus") == "F").alias("has_champion"),
    )
    rivals = (
        lineitem.filter("l_returnflag = 'R'")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("opportunity_id"))
        .agg(F.min("p_brand").alias("competitor_mentioned"))
    )
    return per_order.join(rivals, "opportunity_id", "left")


@job
def opportunities(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame, deal_signals: DataFrame, *, as_of) -> DataFrame:
    key, status, rank = F.col("o_orderkey"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    stage = cases(
        [
            ((status == "F") & (key % 3 == 0), "Closed Lost"),
            (status == "F", "Closed Won"),
            ((status == "P") & (key % 2 == 0), "Negotiation"),
            (status == "P", "Verbal Commit"),
            (rank == "1", "Proposal"),
            (rank == "2", "Solution Design"),
            (rank == "4", "Prospecting"),
        ],
        "Discovery",
    )
    ordered, today = F.to_date("o_orderdate"), F.lit(as_of)
    age = F.datediff(today, ordered)
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyers = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("account_name"),
        by_value("c_mktsegment", SEGMENTS, "SMB").alias("segment"),
        by_value("c_mktsegment", INDUSTRIES, "Healthcare").alias("industry"),
        F.col("r_name").alias("region"),
    )
    base = orders.select(
        key.alias("opportunity_id"),
        F.col("o_custkey").alias("account_id"),
        F.concat(F.lit("Deal "), key.cast("string")).alias("opportunity_name"),
        F.col("o_totalprice").alias("amount"),
        stage.alias("stage_name"),
        (status == "F").alias("is_closed"),
        age.alias("_age"),
        ordered.alias("_ordered"),
    )
    closed, k = F.col("is_closed"), F.col("opportunity_id")
    dated = base.join(buyers, "account_id", "left").join(deal_signals, "opportunity_id", "left").withColumns(
        {
            "is_won": F.col("stage_name") == "Closed Won",
            "forecast_category": by_value("stage_name", FORECAST_CATEGORY, "Pipeline"),
            "win_probability": by_value("stage_name", {s: float(p) for s, p in WIN_PERCENT.items()}, 0.0),
            "created_date": F.when(closed, F.col("_ordered")).otherwise(F.date_sub(today, 30 + F.col("_age") % 180)),
            "close_date": F.when(closed, F.date_add("_ordered", (30 + k % 120).cast("int"))).otherwise(
                F.date_add(today, (k % 180 - 60).cast("int"))
            ),
            "days_in_current_stage": F.when(closed, F.lit(0)).otherwise(F.col("_age") % 60),
            "last_activity_date": F.date_sub(today, F.datediff(today, F.to_date("last_ship")) % 45),
            "is_competitive": F.col("competitor_mentioned").isNotNull(),
            "owner_name": F.concat(F.lit("Rep "), F.col("owner_id").cast("string")),
            "manager_id": F.col("owner_id") % 8,
            "manager_name": F.concat(F.lit("Manager "), (F.col("owner_id") % 8).cast("string")),
            "next_step": F.when(k % 4 != 0, F.lit("Follow up")),
            "loss_reason": F.when(
                F.col("stage_name") == "Closed Lost",
                by_value(k % 5, {0: "Price", 1: "Product Gap", 2: "No Decision", 3: "Competitor"}, "Timing"),
            ),
            "lead_source": by_value(k % 4, {0: "Inbound", 1: "Outbound", 2: "Partner"}, "Event"),
            "deal_type": F.when(k % 2 == 0, F.lit("New Business")).otherwise(F.lit("Expansion")),
            "product": F.concat(F.lit("Product "), (k % 6).cast("string")),
            "is_hero_deal": k % 100 == 7,
            "health_score_override": F.when(k % 50 == 0, (20 + k % 79).cast("int")),
        }
    )
    return dated.withColumns(
        {
            "probability": F.col("win_probability") / 100,
            "days_to_close": F.datediff("close_date", F.when(closed, F.col("created_date")).otherwise(today)),
        }
    ).drop("_age", "_ordered", "last_ship")


@job
def sales_reps(supplier: DataFrame, nation: DataFrame, region: DataFrame, *, as_of) -> DataFrame:
    k = F.col("s_suppkey")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    quota = (1 + k % 10) * 1000000.0
    attained = (40 + (k * 37) % 100) / 100
    served = (20 + (37 * k) % 1500).cast("int")
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        k.alias("rep_id"),
        F.concat(F.lit("Rep "), k.cast("string")).alias("rep_name"),
        (k % 8).alias("manager_id"),
        F.concat(F.lit("Manager "), (k % 8).cast("string")).alias("manager_name"),
        F.col("r_name").alias("region"),
        by_value(k % 3, {0: "Enterprise", 1: "Mid-Market"}, "SMB").alias("segment"),
        F.date_sub(F.lit(as_of), served).alias("start_date"),
        F.floor(served / 30).cast("int").alias("tenure_months"),
        quota.alias("quota"),
        quota.alias("annual_quota"),
        (quota / 4).alias("quarterly_quota"),
        F.round(quota * attained, 2).alias("ytd_closed_revenue"),
        F.round(quota * attained / 4, 2).alias("q4_closed_revenue"),
        attained.alias("ytd_attainment"),
        ((15 + (k * 13) % 40) / 100).alias("win_rate"),
        (50000 + (k * 7001) % 200000).cast("double").alias("avg_deal_size"),
        (30 + (k * 11) % 90).cast("int").alias("avg_sales_cycle_days"),
        ((10 + (k * 7) % 40) / 10).alias("avg_stakeholders"),
        (5 + (k * 3) % 30).cast("int").alias("deals_in_pipeline"),
        (20 + (k * 17) % 80).cast("int").alias("activities_this_month"),
        ((10 + (k * 19) % 40) / 10).alias("pipeline_coverage"),
        F.round(quota / 4 * (10 + (k * 19) % 40) / 10, 2).alias("current_pipeline"),
        F.concat(F.lit("rep"), k.cast("string"), F.lit("@sales.example")).alias("email"),
        F.when(k % 4 == 0, F.lit("Senior AE")).otherwise(F.lit("AE")).alias("role"),
        (40 + (k % 5) * 40).cast("int").alias("max_deals"),
    )


@job
def quotas(sales_reps: DataFrame) -> DataFrame:
    return sales_reps.select("rep_id", F.col("quarterly_quota").alias("quota_amount"))


@job
def accounts(customer: DataFrame, nation: DataFrame, region: DataFrame, *, as_of) -> DataFrame:
    k = F.col("c_custkey")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        k.alias("account_id"),
        F.col("c_name").alias("account_name"),
        by_value("c_mktsegment", SEGMENTS, "SMB").alias("segment"),
        by_value("c_mktsegment", INDUSTRIES, "Healthcare").alias("industry"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("territory"),
        ((k * 7919) % 2000 * 100000.0).alias("annual_revenue"),
        ((k * 31) % 2500).cast("int").alias("employee_count"),
        F.round(F.greatest("c_acctbal", F.lit(0.0)) * 10, 2).alias("current_arr"),
        (20 + k % 80).cast("int").alias("health_score"),
        F.floor(k / 15).alias("owner_id"),
        F.date_sub(F.lit(as_of), (30 + (k * 53) % 2000).cast("int")).alias("created_date"),
        F.date_add(F.lit(as_of), ((k * 29) % 365).cast("int")).alias("renewal_date"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit(".example")).alias("domain"),
    )


@job
def activities(events: DataFrame, *, as_of) -> DataFrame:
    on = F.date_sub(F.to_date("ts"), EVENT_SHIFT_DAYS)
    return events.select(
        F.col("event_id").alias("activity_id"),
        by_value("event_type", ACTIVITY_TYPES, "Task").alias("activity_type"),
        F.concat(F.initcap("event_type"), F.lit(" touch")).alias("subject"),
        F.floor(F.col("event_id") / 3).alias("opportunity_id"),
        F.col("user_id").alias("account_id"),
        F.col("user_id").alias("owner_id"),
        (F.col("event_id") % 5).alias("contact_id"),
        on.alias("activity_date"),
        F.floor("value").cast("int").alias("duration_minutes"),
        (on <= F.lit(as_of)).alias("is_completed"),
    )


@job
def process_events(events: DataFrame, stage_benchmarks: DataFrame) -> DataFrame:
    """Event log: one hour of the source clock counts as one day in a step."""
    steps = events.select(
        "event_id",
        F.col("user_id").alias("case_id"),
        by_value("event_type", PROCESS_STEPS, "Security Review").alias("activity"),
        F.col("ts").alias("timestamp"),
        (F.col("value") * 1000).alias("_worth"),
        F.concat(F.lit("Team "), (F.col("event_id") % 5).cast("string")).alias("resource"),
    )
    end = F.lit(EVENT_CLOCK_END).cast("timestamp_ntz")
    timed = next_time(steps, "case_id", "timestamp", "event_id", "_next")
    first_seen = steps.groupBy("case_id", "activity").agg(F.min("timestamp").alias("_first_seen"))
    bench = stage_benchmarks.select(F.col("stage_name").alias("activity"), F.col("expected_days").alias("benchmark_days"))
    waited = F.timestamp_diff("HOUR", F.col("timestamp"), F.coalesce("_next", end)).cast("int")
    return (
        timed.join(first_seen, ["case_id", "activity"], "left")
        .join(bench, "activity", "left")
        .withColumn("duration_days", waited)
        .select(
            "event_id", "case_id", "activity", "timestamp", "resource",
            F.round("_worth", 2).alias("amount"),
            "duration_days", "benchmark_days",
            (F.col("duration_days") - F.col("benchmark_days")).alias("deviation_days"),
            nvl(F.col("duration_days") > F.col("benchmark_days") * 1.5, False).alias("is_bottleneck"),
            (F.col("timestamp") > F.col("_first_seen")).alias("is_rework"),
        )
    )


@job
def leads(events: DataFrame) -> DataFrame:
    """One lead per sign-up event; the user's next event is the first response."""
    k = F.col("event_id")
    return next_time(events, "user_id", "ts", "event_id", "next_ts").filter("event_type = 'signup'").select(
        k.alias("lead_id"),
        "user_id",
        by_value(k % 4, {0: "Inbound", 1: "Outbound", 2: "Partner"}, "Event").alias("lead_source"),
        by_value(F.col("user_id") % 3, {0: "Enterprise", 1: "Mid-Market"}, "SMB").alias("segment"),
        by_value(k % 7, {0: "MQL", 1: "MQL", 2: "SQL", 3: "Qualified", 4: "Converted", 5: "Disqualified"}, "New").alias("status"),
        F.least(F.floor("value").cast("int"), F.lit(100)).alias("lead_score"),
        F.col("ts").alias("created_date"),
        F.col("next_ts").alias("first_response_date"),
    )


@job
def lead_touches(events: DataFrame) -> DataFrame:
    """The event that answered a lead."""
    timed = next_time(events, "user_id", "ts", "event_id", "answer", "event_type")
    return timed.filter("event_type = 'signup' AND answer IS NOT NULL").select(
        F.col("event_id").alias("lead_id"), "user_id", F.col("answer.ts").alias("activity_date"), by_value("answer.event_type", ACTIVITY_TYPES, "Task").alias("activity_type")
    )


def shifted(ts: str = "ts"):
    """Event time moved onto the order calendar."""
    return F.expr(f"{ts} - INTERVAL '{EVENT_SHIFT_DAYS}' DAY")


@job
def contacts(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("contact_id"),
        k.alias("account_id"),
        F.concat(F.lit("First"), (k % 20).cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), (k % 50).cast("string")).alias("last_name"),
        F.concat(F.lit("c"), (k % 400).cast("string"), F.lit("@mail.example")).alias("email"),
        (k % 3 != 0).alias("is_primary"),
    )


@job
def product_events(events: DataFrame) -> DataFrame:
    # Fixed values of the mapping: feature names by event type.
    features = {"click": "core_click", "view": "core_view", "purchase": "premium_purchase", "signup": "signup"}
    return events.select(
        F.col("user_id").alias("account_id"),
        (F.col("event_id") % 7).alias("user_id"),
        by_value("event_type", features, "error").alias("event_name"),
        shifted().alias("event_timestamp"),
    )


@job
def tickets_raw(events: DataFrame) -> DataFrame:
    """One support ticket per error event, solved at the user's next event."""
    k = F.col("event_id")
    status = by_value(k % 4, {0: "open", 1: "pending", 2: "solved"}, "closed")
    done = (k % 4) >= 2
    domain = F.concat(F.lit("customer"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit(".example"))
    return next_time(events, "user_id", "ts", "event_id", "next_ts").filter("event_type = 'error'").select(
        k.alias("id"),
        F.col("user_id").alias("organization_id"),
        F.concat(F.lit("u"), (k % 9).cast("string"), F.lit("@"), F.when(k % 3 == 0, domain).otherwise(F.lit("other.example"))).alias("requester_email"),
        F.concat(F.lit("Ticket "), k.cast("string")).alias("subject"),
        status.alias("status"),
        cases([(F.col("value") > 100, "urgent"), (F.col("value") > 50, "high"), (F.col("value") > 20, "normal")], "low").alias("priority"),
        shifted().alias("created_at"),
        F.when(done, shifted("next_ts")).alias("solved_at"),
        F.when(done, (1 + k % 5).cast("int")).alias("satisfaction_rating"),
    )


@job
def account_domains(accounts: DataFrame) -> DataFrame:
    return accounts.select("domain", "account_id")


@job
def marketing_raw(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.filter(F.col("event_type").isin("click", "view")).select(
        k.alias("id"),
        F.col("user_id").alias("leadId"),
        (k % 12).cast("int").alias("activityTypeId"),
        shifted().alias("activityDate"),
        (k % 8).alias("campaignId"),
        F.concat(F.lit("Asset "), (k % 15).cast("string")).alias("primaryAttributeValue"),
    )


@job
def sales_interventions(orders: DataFrame, *, as_of) -> DataFrame:
    """Recorded decisions on open deals."""
    k = F.col("o_orderkey")
    before = (30 + k % 40).cast("int")
    return orders.filter(F.col("o_orderstatus") != "F").select(
        F.concat(F.lit("DEC-"), k.cast("string")).alias("decision_id"),
        F.date_add(F.lit(as_of), (k % 10).cast("int")).alias("decision_date"),
        by_value(k % 4, {0: "Rep", 1: "Manager", 2: "VP"}).alias("actor_role"),
        k.alias("opportunity_id"),
        F.concat(F.lit("ACT-"), k.cast("string")).alias("action_id"),
        by_value(k % 5, {0: "Accept", 1: "Override", 2: "Defer", 3: "Escalate"}).alias("decision_type"),
        before.alias("pre_health_score"),
        (before + k % 30 - 5).cast("int").alias("post_health_score"),
        (F.col("o_totalprice") * 0.5).alias("expected_impact_amount"),
        (F.col("o_totalprice") * (k % 4) * 0.25).alias("realized_impact_amount"),
        by_value(k % 7, {0: "Won", 1: "Lost", 2: "Slip"}, "Open").alias("result"),
        F.when(k % 11 != 0, F.lit("Q4 2001")).alias("quarter"),
    )

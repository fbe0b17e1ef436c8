"""Usage quotas, overages, invoices, contracts, and webhook / sync / notification analytics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotaloom.functions.exprs import at_least, by_value, cases, days_ahead, exact_sum, in_quarter, nvl, present, ratio, side_by_side, stack_rows, tally, under
from quotaloom.functions.intervals import interval_join
from quotaloom.functions.ordered import exact_quantiles
from quotaloom.operators.commercial import up_to
from quotaloom.plans.registry import job

# Plan, meter, included (none = unlimited), cap type, overage price.
PLAN_LIMITS = (
    ("starter", "seats", 20, "hard", 20.0), ("starter", "deals", 10000, "soft", 0.01), ("starter", "ai_insight_credits", 2000, "soft", 0.02),
    ("starter", "workspaces", 1, "hard", None), ("starter", "api_calls", 0, "hard", None), ("starter", "agent_actions", 500, "soft", 0.05),
    ("growth", "seats", 75, "soft", 15.0), ("growth", "deals", 100000, "soft", 0.008), ("growth", "ai_insight_credits", 10000, "soft", 0.015),
    ("growth", "workspaces", 2, "soft", 300.0), ("growth", "api_calls", 50000, "soft", 0.0005), ("growth", "agent_actions", 2500, "soft", 0.03),
    ("growth", "webhook_deliveries", 10000, "soft", 0.001),
    ("enterprise", "seats", None, "none", None), ("enterprise", "deals", None, "none", None), ("enterprise", "ai_insight_credits", 50000, "soft", 0.01),
    ("enterprise", "workspaces", 5, "soft", 250.0), ("enterprise", "api_calls", 500000, "soft", 0.0002), ("enterprise", "agent_actions", 10000, "soft", 0.02),
    ("enterprise", "webhook_deliveries", 100000, "soft", 0.0005), ("enterprise", "data_storage_gb", 50, "soft", 0.5), ("enterprise", "conversation_minutes", 1000, "soft", 3.0),
    ("enterprise", "custom_model_inferences", 10000, "soft", 0.002),
)
# Add-on price per month and unit, and the quota it adds.
ADD_ONS = {"coaching_ai": ("Coaching AI", 2000.0, False, "ai_insight_credits", 10000), "data_export": ("Data Export API", 150.0, False, "api_calls", 100000), "extra_workspace": ("Additional Workspace", 300.0, True, None, None)}
PLANS = {"starter": ("Starter", 499.0, 4990.0), "growth": ("Growth", 1499.0, 14990.0), "enterprise": ("Enterprise", 4999.0, 49990.0)}
# Region tax rate, type and reverse charge.
TAXES = {"US": (0, "sales_tax", False), "EU": (20, "vat", True), "UK": (20, "vat", False), "APAC": (10, "gst", False), "LATAM": (16, "vat", False), "GLOBAL": (0, "none", False)}
UPGRADE = {"starter": "growth", "growth": "enterprise"}


@job
def plan_limits(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(PLAN_LIMITS), "plan_code string, meter string, included bigint, cap_type string, overage_price double"))


def plan_price(plan: str, interval: str = "billing_interval", months: int = 1) -> Column:
    yearly = by_value(plan, {p: v[2] for p, v in PLANS.items()})
    monthly = by_value(plan, {p: v[1] for p, v in PLANS.items()})
    return F.when(F.col(interval) == "annual", yearly / 12 * months if months != 12 else yearly).otherwise(monthly * months)


def period_of(as_of) -> str:
    return f"{as_of:%Y-%m}"


@job
def meter_usage(usage_records: DataFrame) -> DataFrame:
    return usage_records.groupBy("tenant_id", "meter", F.date_format("used_at", "yyyy-MM").alias("period")).agg(F.sum("quantity").alias("used"), F.count("*").alias("records"))


@job
def quota_enforcement(subscriptions: DataFrame, subscription_add_ons: DataFrame, plan_limits: DataFrame, meter_usage: DataFrame, *, as_of) -> DataFrame:
    """Included = plan + active add-ons; a hard cap blocks once the quota is used up."""
    gives = subscription_add_ons.filter(F.col("deactivated_on").isNull()).select(
        "tenant_id", by_value("add_on", {a: v[3] for a, v in ADD_ONS.items() if v[3]}).alias("meter"), by_value("add_on", {a: v[4] for a, v in ADD_ONS.items() if v[4]}).alias("more")
    )
    extra = gives.filter(F.col("meter").isNotNull()).groupBy("tenant_id", "meter").agg(F.sum("more").alias("more"))
    used = meter_usage.filter(F.col("period") == period_of(as_of)).select("tenant_id", "meter", "used")
    limit, spent, cap = F.col("included"), F.col("used"), F.col("cap_type")
    full = spent >= limit
    return (
        subscriptions.select("tenant_id", "plan_code")
        .join(plan_limits, "plan_code")
        .join(extra, ["tenant_id", "meter"], "left")
        .join(used, ["tenant_id", "meter"], "left")
        .withColumns({"used": nvl("used", 0), "included": limit + nvl("more", 0), "unlimited": limit.isNull()})
        .withColumns(
            {
                "remaining": F.greatest(F.lit(0).cast("bigint"), limit - spent), "overage": nvl(F.greatest(F.lit(0).cast("bigint"), spent - limit), 0),
                "overage_cost": F.round(nvl(F.greatest(F.lit(0).cast("bigint"), spent - limit), 0) * nvl("overage_price", 0.0), 6),
                "allowed": ~(nvl(full, False) & (cap == "hard")),
                "would_exceed_by_one": nvl(spent + 1 > limit, False) & (cap == "hard"),
                "message": cases([(full & (cap == "hard"), "limit reached"), (full & (cap == "soft"), "overage charges apply")]),
            }
        )
        .drop("more")
    )


@job
def usage_threshold_crossings(usage_records: DataFrame, quota_enforcement: DataFrame, *, as_of) -> DataFrame:
    """Day on which a tenant's month-to-date use first reached 70, 90 and 100 %.

    Use is summed per day first; the running total covers one tenant's days.
    """
    daily = (
        usage_records.filter(F.date_format("used_at", "yyyy-MM") == period_of(as_of))
        .groupBy("tenant_id", "meter", F.to_date("used_at").alias("day"))
        .agg(F.sum("quantity").alias("q"))
        .withColumn("total", F.sum("q").over(Window.partitionBy("tenant_id", "meter").orderBy("day")))
    )
    limits = quota_enforcement.filter("NOT unlimited AND included > 0").select("tenant_id", "meter", "included", "cap_type")
    joined = daily.join(limits, ["tenant_id", "meter"]).withColumn("before", F.col("total") - F.col("q"))
    hit = lambda p: F.when((F.col("total") * 100 >= F.col("included") * p) & (F.col("before") * 100 < F.col("included") * p), F.struct(F.lit(p).alias("threshold")))
    return stack_rows(joined, [hit(p) for p in (70, 90, 100)], ["tenant_id", "meter", "day", "total", "included", "cap_type"])


@job
def overage_charges(subscriptions: DataFrame, plan_limits: DataFrame, meter_usage: DataFrame) -> DataFrame:
    """Billable overage of the plan limit alone; add-on quota does not count here."""
    over = F.col("used") - F.col("included")
    return (
        meter_usage.hint("merge").join(subscriptions.select("tenant_id", "plan_code"), "tenant_id")
        .join(plan_limits, ["plan_code", "meter"])
        .filter((over > 0) & F.col("overage_price").isNotNull())
        .select("tenant_id", "period", "meter", "used", "included", over.alias("overage"), F.col("overage_price").alias("unit_price"), F.round(over * F.col("overage_price"), 6).alias("total"))
    )


@job
def invoice_lines(subscriptions: DataFrame, subscription_add_ons: DataFrame, overage_charges: DataFrame, *, as_of) -> DataFrame:
    """Base price, add-ons alive in the period, and overages of one month."""
    start = as_of.replace(day=1)
    base = subscriptions.select(
        "tenant_id", F.lit("subscription").alias("type"), by_value("plan_code", {p: v[0] for p, v in PLANS.items()}).alias("item"), F.lit(1.0).alias("quantity"), plan_price("plan_code").alias("amount")
    )
    unit = by_value("add_on", {a: v[1] for a, v in ADD_ONS.items()})
    per_unit = by_value("add_on", {a: v[2] for a, v in ADD_ONS.items()})
    extras = subscription_add_ons.filter(F.col("deactivated_on").isNull() | (F.col("deactivated_on") >= F.lit(start))).select(
        "tenant_id", F.lit("addon").alias("type"), by_value("add_on", {a: v[0] for a, v in ADD_ONS.items()}).alias("item"), F.col("quantity").cast("double").alias("quantity"),
        F.when(per_unit, unit * F.col("quantity")).otherwise(unit).alias("amount"),
    )
    over = overage_charges.filter(F.col("period") == period_of(as_of)).select(
        "tenant_id", F.lit("overage").alias("type"), F.col("meter").alias("item"), F.col("overage").cast("double").alias("quantity"), F.col("total").alias("amount")
    )
    return reduce(DataFrame.unionByName, [base, extras, over]).withColumns({"period": F.lit(period_of(as_of)), "amount": F.round("amount", 6)})


def tax_rate(region: str = "region") -> Column:
    free = by_value(region, {r: v[2] for r, v in TAXES.items()}, False) & F.col("has_tax_id")
    return F.when(free, F.lit(0)).otherwise(by_value(region, {r: v[0] for r, v in TAXES.items()}, 0))


@job
def invoices(invoice_lines: DataFrame, subscriptions: DataFrame, *, as_of) -> DataFrame:
    """Subtotal, discount, tax on the net amount, total and due date per tenant."""
    per = invoice_lines.groupBy("tenant_id", "period").agg(exact_sum("amount", 6).alias("subtotal"), F.count("*").alias("lines"))
    sub, off = F.col("subtotal"), F.col("discount_amount")
    return (
        per.join(subscriptions.select("tenant_id", "discount_percent", "region", "has_tax_id"), "tenant_id")
        .withColumns({"discount_amount": F.round(sub * F.col("discount_percent") / 100, 6), "tax_rate": tax_rate()})
        .withColumn("tax_amount", F.round((sub - off) * F.col("tax_rate") / 100, 6))
        .withColumns({"total": F.round(sub - off + F.col("tax_amount"), 4), "due_date": F.date_add(F.lit(as_of), 30), "status": F.lit("draft")})
    )


@job
def plan_change_proration(subscriptions: DataFrame, *, as_of) -> DataFrame:
    """Credit and charge lines for moving each upgradable tenant to the next plan today."""
    moving = subscriptions.filter(F.col("plan_code").isin(*UPGRADE) & (F.col("contract_end") > F.lit(as_of))).withColumn("new_plan", by_value("plan_code", UPGRADE))
    left = F.greatest(days_ahead(as_of, "contract_end"), F.lit(0))
    daily = lambda plan: plan_price(plan, months=12) / 365
    line = lambda kind, plan, sign: F.struct(F.lit(kind).alias("type"), F.col(plan).alias("plan"), F.round(sign * daily(plan) * left, 4).alias("amount"))
    return moving.select("tenant_id", left.alias("remaining_days"), F.inline(F.array(line("credit", "plan_code", -1.0), line("charge", "new_plan", 1.0))))


@job
def ramp_step_in_force(ramp_steps: DataFrame, subscriptions: DataFrame, *, as_of) -> DataFrame:
    """Step valid on the evaluation date (start <= date < end) and the MRR it gives."""
    today = F.lit(as_of)
    live = ramp_steps.filter((F.col("start_date") <= today) & (today < F.col("end_date")))
    first = live.groupBy("tenant_id").agg(F.min_by(F.struct("step", "plan_code", "price_override"), F.struct("start_date", "step")).alias("s")).select("tenant_id", "s.*")
    base = F.coalesce(F.col("price_override"), plan_price("plan_code"))
    return first.join(subscriptions.select("tenant_id", "billing_interval", "discount_percent"), "tenant_id").select(
        "tenant_id", "step", "plan_code", base.alias("base_price_per_month"), F.round(base - base * F.col("discount_percent") / 100, 6).alias("contracted_mrr")
    )


@job
def contract_renewals(subscriptions: DataFrame, *, as_of) -> DataFrame:
    """Renewal outcome, reminder window and the discounted MRR with its approval flag."""
    base, off, left = plan_price("plan_code"), F.col("discount_percent"), days_ahead(as_of, "contract_end")
    stop = F.col("cancel_at_period_end")
    return subscriptions.select(
        "tenant_id", "plan_code", "contract_end", left.alias("days_to_renewal"),
        under(left, ((0, "lapsed"), (31, "30_days"), (61, "60_days"), (91, "90_days")), "later").alias("reminder"),
        F.when(stop, F.lit("canceled")).otherwise(F.lit("renewed")).alias("status"),
        F.when(~stop, F.add_months("contract_end", F.col("term_months"))).alias("new_contract_end"),
        base.alias("base_price_per_month"), F.round(base - base * off / 100, 6).alias("contracted_mrr"), (off > 20).alias("needs_approval"),
        F.date_add(F.lit(as_of), 14).alias("quote_expires"),
    )


@job
def upgrade_nudges(quota_enforcement: DataFrame, subscriptions: DataFrame, *, as_of) -> DataFrame:
    """Limit reached / approaching per meter, and trials ending within a week."""
    share = F.col("used") / F.col("included")
    near = (
        quota_enforcement.filter(F.col("meter").isin("seats", "deals", "agent_actions") & (F.col("included") > 0) & (share >= 0.8))
        .select("tenant_id", F.when(share >= 1, F.lit("limit_reached")).otherwise(F.lit("limit_approaching")).alias("nudge"), "meter",
                F.concat(F.format_string("%.0f", share * 100), F.lit("% of "), F.col("meter"), F.lit(" used")).alias("message"))
    )
    left = days_ahead(as_of, "trial_ends")
    trial = subscriptions.filter(left.between(0, 7)).select("tenant_id", F.lit("trial_ending").alias("nudge"), F.lit(None).cast("string").alias("meter"), F.format_string("Trial ends in %d days", left).alias("message"))
    return near.unionByName(trial)


@job
def action_outcomes(agent_actions: DataFrame) -> DataFrame:
    result, said = F.col("result"), F.col("feedback")
    return agent_actions.groupBy("customer_id").agg(
        F.count("*").alias("total"), *[tally(result == r).alias(r) for r in ("success", "failed", "pending")],
        ratio(tally(result == "success"), tally(result.isin("success", "failed")), empty=0).alias("success_rate"),
        F.avg("rating").alias("avg_rating"), tally(said == "accepted").alias("accepted"), tally(said == "rejected").alias("rejected"),
    )


@job
def webhook_failure_state(webhook_deliveries: DataFrame) -> DataFrame:
    """Failures since the last success per webhook; two aggregates instead of an ordered window."""
    ok = F.col("status") == "delivered"
    last = webhook_deliveries.groupBy("webhook_id").agg(F.max(F.when(ok, F.struct("created_at", "delivery_id"))).alias("last_ok"), tally(ok).alias("success_count"), tally(~ok).alias("failure_count"))
    at = F.struct("created_at", "delivery_id")
    run = webhook_deliveries.join(last.select("webhook_id", "last_ok"), "webhook_id").filter(~ok & (F.col("last_ok").isNull() | (at > F.col("last_ok")))).groupBy("webhook_id").agg(F.count("*").alias("consecutive_failures"))
    n = F.col("consecutive_failures")
    return (
        last.drop("last_ok").join(run, "webhook_id", "left").withColumn("consecutive_failures", nvl("consecutive_failures", 0))
        .withColumns(
            {
                "status": at_least(n, ((10, "suspended"), (5, "failing")), "active"),
                "success_rate": ratio("success_count", F.col("success_count") + F.col("failure_count"), empty=1),
                "backoff_ms": F.when(n > 0, 1000 * F.pow(F.lit(2.0), n - 1)).otherwise(F.lit(0.0)),
            }
        )
    )


@job
def webhook_rollup(webhook_deliveries: DataFrame) -> DataFrame:
    """Totals, rates and latency overall, per tenant and per webhook from one scan."""
    status = F.col("status")
    return (
        webhook_deliveries.groupingSets([[], ["customer_id"], ["customer_id", "webhook_id"]], "customer_id", "webhook_id")
        .agg(
            by_value(F.grouping_id(), {3: "all", 1: "tenant"}, "webhook").alias("level"), F.count("*").alias("total"), tally(status == "delivered").alias("delivered"),
            tally(status == "failed").alias("failed"), F.avg("response_time_ms").alias("avg_latency_ms"),
        )
        .withColumn("success_rate", ratio("delivered", F.col("delivered") + F.col("failed"), empty=1))
    )


@job
def webhook_error_buckets(webhook_deliveries: DataFrame) -> DataFrame:
    """Error kinds and latency bands with their share (window over a handful of rows)."""
    code, ms = F.col("response_code"), F.col("response_time_ms")
    kind = cases([(code.isNull(), "connection"), (code.between(400, 499), "http_4xx"), (code.between(500, 599), "http_5xx")])
    band = under(ms, ((100, "<100ms"), (500, "100-500ms"), (1000, "500ms-1s"), (5000, "1-5s")), ">5s")
    rows = F.array_compact(F.array(F.when(kind.isNotNull(), F.struct(F.lit("error").alias("view"), kind.alias("bucket"))), F.struct(F.lit("latency").alias("view"), band.alias("bucket"))))
    return (
        webhook_deliveries.select(F.inline(rows)).groupBy("view", "bucket").agg(F.count("*").alias("count"))
        .withColumn("percentage", F.round(F.col("count") * 100 / F.sum("count").over(Window.partitionBy("view")), 4))
    )


# Stale-sync limit in hours per system.
STALE_HOURS = {"crm_a": 24, "crm_b": 24, "helpdesk": 48, "warehouse": 168, "chat": 1}


@job
def sync_state(sync_log: DataFrame, *, as_of) -> DataFrame:
    """Latest state per tenant and system; an error soon after a success is a warning."""
    end = F.date_add(F.lit(as_of), 1).cast("timestamp_ntz")
    good = F.col("status") == "success"
    hours = lambda c: F.timestamp_diff("SECOND", F.col(c), end) / 3600
    latest = sync_log.filter(up_to(as_of, "last_sync_at")).groupBy("customer_id", "source_system").agg(
        F.max_by("status", F.struct("last_sync_at", "records_synced")).alias("last_status"), F.max("last_sync_at").alias("last_sync_at"),
        F.max(F.when(good, F.col("last_sync_at"))).alias("last_success_at"),
    )
    recent = F.timestamp_diff("SECOND", F.col("last_success_at"), F.col("last_sync_at")) < 3600
    limit = by_value("source_system", STALE_HOURS, 24)
    return latest.withColumns(
        {
            "state": cases([(F.col("last_status") == "success", "ok"), (F.col("last_status") == "warning", "warning"), (recent, "warning")], "error"),
            "hours_since_sync": hours("last_sync_at"), "stale_limit_hours": limit, "is_stale": hours("last_sync_at") > limit,
        }
    )


@job
def tenant_sync_health(sync_state: DataFrame) -> DataFrame:
    """Worst state per tenant and the counts behind it."""
    state = F.col("state")
    rank = F.max(by_value(state, {"error": 3, "warning": 2}, 0))
    return sync_state.groupBy("customer_id").agg(
        by_value(rank, {3: "error", 2: "warning"}, "ok").alias("worst_state"), F.count("*").alias("systems"), *[tally(state == s).alias(f"{s}_systems") for s in ("ok", "warning", "error")],
        tally("is_stale").alias("stale_systems"),
    )


@job
def sync_system_counts(sync_state: DataFrame) -> DataFrame:
    return sync_state.groupBy("source_system").agg(F.count("*").alias("total"), *[tally(F.col("state") == s).alias(s) for s in ("ok", "warning", "error")])


@job
def integration_health(sync_state: DataFrame, active_alerts: DataFrame) -> DataFrame:
    """100 less 20 / 10 per failing / warning sync and 15 / 5 per critical / other alert."""
    state, critical = F.col("state"), F.col("severity") == "critical"
    syncs = sync_state.groupBy("customer_id").agg((tally(state == "error") * 20 + tally(state == "warning") * 10).alias("s"))
    alerts = active_alerts.groupBy("customer_id").agg((tally(critical) * 15 + tally(~critical) * 5).alias("a"))
    return (
        syncs.join(alerts, "customer_id", "full_outer")
        .select("customer_id", F.greatest(F.lit(0).cast("bigint"), 100 - nvl("s", 0) - nvl("a", 0)).alias("health_score"))
        .withColumn("overall_health", at_least("health_score", ((80, "healthy"), (50, "degraded")), "unhealthy"))
    )


@job
def notification_channels(notification_log: DataFrame) -> DataFrame:
    """Delivery, read rate and latency percentiles per channel and type."""
    status = F.col("status")
    keys = ["channel", "notification_type"]
    timed = notification_log.withColumn("_latency", F.timestamp_diff("SECOND", F.col("sent_at"), F.col("delivered_at")))
    p = exact_quantiles(timed, keys, "_latency", {"p50_seconds": 0.5, "p90_seconds": 0.9, "p95_seconds": 0.95, "p99_seconds": 0.99})
    return (
        notification_log.groupBy(*keys)
        .agg(F.count("*").alias("total"), tally(status.isin("delivered", "read")).alias("delivered"), tally(status == "read").alias("read"), tally(status == "failed").alias("failed"))
        .join(p, keys, "left")
        .withColumns(
            {
                "delivery_rate": ratio("delivered", "total", empty=0), "read_rate": ratio("read", "delivered", empty=0),
                "issues": F.array_join(present(F.when(F.col("delivered") * 100 < F.col("total") * 90, F.lit("low delivery rate")), F.when(F.col("p95_seconds") > 5, F.lit("p95 above 5 s"))), "; "),
            }
        )
    )


@job
def impact_summary(impact_tracker: DataFrame) -> DataFrame:
    """Totals over all groups with a decision-weighted average time."""
    made, days = F.col("actions_with_decision"), F.col("avg_time_to_decision_days")
    return impact_tracker.agg(
        F.sum("actions_created").alias("actions_created"), F.sum(made).alias("actions_with_decision"),
        exact_sum("total_expected_impact_amount").alias("expected_impact"), exact_sum("total_realized_impact_amount", 4).alias("realized_impact"),
        F.round(F.try_divide(exact_sum(days * made, 4), F.sum(made)), 4).alias("weighted_time_to_decision"),
    )


# Alert rules: id, metric, operator, threshold, severity.
METRIC_RULES = (
    ("stale_pipeline", "stale_deal_pct", ">", 0.30, "warning"), ("critical_deals", "critical_deal_count", ">=", 5.0, "critical"), ("low_win_rate", "win_rate", "<", 0.20, "warning"),
    ("coverage_low", "pipeline_coverage", "<=", 3.0, "warning"), ("no_owner", "unowned_deals", "!=", 0.0, "info"), ("zero_pipeline", "open_deals", "==", 0.0, "critical"),
)


@job
def metric_rule_alerts(deal_health: DataFrame, quotas: DataFrame) -> DataFrame:
    """Metrics in one aggregation, unpivoted, and each rule's comparison applied."""
    live = ~F.col("is_closed")
    one = deal_health.agg(
        (tally(live & (F.col("days_since_activity") > 14)) / F.greatest(tally(live), F.lit(1))).alias("stale_deal_pct"),
        tally(live & (F.col("health_category") == "Critical")).cast("double").alias("critical_deal_count"),
        (tally("is_won") / F.greatest(tally("is_closed"), F.lit(1))).alias("win_rate"), tally(live).cast("double").alias("open_deals"),
        tally(live & F.col("owner_id").isNull()).cast("double").alias("unowned_deals"), exact_sum("amount", where=live).alias("_pool"),
    )
    one = one.withColumn("pipeline_coverage", F.round(F.try_divide(F.col("_pool"), quotas.agg(exact_sum("quota_amount")).scalar()), 6))
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    rows = [
        F.struct(
            F.lit(i).alias("rule_id"), F.lit(m).alias("metric_name"), F.col(m).alias("metric_value"), F.lit(op).alias("operator"), F.lit(t).alias("threshold"), F.lit(s).alias("severity"),
            compare[op](F.col(m), F.lit(t)).alias("triggered"),
        )
        for i, m, op, t, s in METRIC_RULES
    ]
    return one.select(F.inline(F.array(*rows)))


# Alert rules of the operations guide: alert, metric, operator, threshold, severity, title, message.
ALERT_RULES = (
    ("stale_pipeline", "stale_deal_pct", ">", 0.10, "warning", "Stale Pipeline Alert", "Pipeline staleness at {value:.1%}, exceeds {threshold:.1%} threshold. {count} deals need attention."),
    ("build_failure", "build_failed", "==", 1.0, "critical", "Build Failure", "Build {build_id} failed for dataset {dataset}. Error: {error}"),
    ("data_quality_drop", "data_quality_score", "<", 0.90, "warning", "Data Quality Alert", "Data quality dropped to {value:.1%}, below {threshold:.1%} threshold."),
    ("sync_delay", "sync_delay_minutes", ">", 60.0, "warning", "CRM Sync Delay", "CRM sync delayed by {value:.0f} minutes (threshold: {threshold:.0f}min)."),
    ("health_critical", "critical_deal_count", ">", 5.0, "warning", "Critical Deals Alert", "{value:.0f} deals in critical health status, representing ${amount:,.0f} at risk."),
    ("forecast_miss", "forecast_variance_pct", ">", 0.20, "warning", "Forecast Variance Alert", "Forecast variance at {value:.1%}, exceeds {threshold:.1%} tolerance."),
    ("quota_at_risk", "quota_attainment_projected", "<", 0.80, "warning", "Quota Attainment Risk", "Projected quota attainment at {value:.1%}, below {threshold:.1%} threshold."),
)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A message template with its ``{name:format}`` places filled; formats are .1%, .0f and ,.0f."""
    parts = []
    for i, part in enumerate(re.split(r"\{([^}]*)\}", template)):
        name, _, form = part.partition(":")
        if i % 2 == 0:
            parts.append(F.lit(part))
        elif form == ".1%":
            parts.append(F.format_string("%.1f%%", F.round(values[name] * 100, 1)))
        elif form:
            parts.append(F.format_string("%,.0f" if "," in form else "%.0f", F.round(values[name], 0)))
        else:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


@job
def alert_rule_events(deal_health: DataFrame, build_log: DataFrame, data_quality_summary: DataFrame, sync_state: DataFrame, forecast_accuracy: DataFrame, quotas: DataFrame, *, as_of) -> DataFrame:
    """The guide's rules on today's metrics: one row per rule, with its message where it fires.

    Variance is that of the recommended forecast method, projected attainment what is won and committed this quarter.
    """
    live, now = ~F.col("is_closed"), F.date_add(F.lit(as_of), 1).cast("timestamp_ntz")
    stale, critical = live & (F.col("days_since_activity") > 14), live & (F.col("health_category") == "Critical")
    deals = deal_health.agg(
        tally(live).alias("_live"), tally(stale).alias("_stale"), tally(critical).alias("_critical"), exact_sum("amount", where=critical).alias("_critical_amount"),
        exact_sum("amount", where=in_quarter(as_of, "close_date") & (F.col("is_won") | (live & (F.col("forecast_category") == "Commit")))).alias("_projected"),
    )
    failed = build_log.filter((F.col("build_timestamp") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("build_timestamp") < now) & (F.col("status") == "FAILED"))
    build = failed.agg(F.count("*").alias("_failed"), F.min_by(F.struct("build_id", "dataset_path", "error_message"), "build_id").alias("_build"))
    behind = sync_state.agg(F.max(F.timestamp_diff("SECOND", F.col("last_success_at"), now) / 60).alias("_delay"))
    quality = data_quality_summary.select(F.col("overall_score").alias("_quality"))
    missed = forecast_accuracy.filter("recommended").agg(F.max(1 - F.col("avg_accuracy")).alias("_missed"))
    goal = quotas.agg(exact_sum("quota_amount").alias("_quota"))
    one = side_by_side(deals, build, behind, quality, missed, goal)
    metrics = {
        "stale_deal_pct": F.col("_stale") / F.greatest("_live", F.lit(1)), "build_failed": (F.col("_failed") > 0).cast("double"), "data_quality_score": F.col("_quality"),
        "sync_delay_minutes": F.col("_delay"), "critical_deal_count": F.col("_critical").cast("double"), "forecast_variance_pct": F.col("_missed"),
        "quota_attainment_projected": F.try_divide("_projected", "_quota"),
    }
    one = one.withColumns({m: F.round(v.cast("double"), 6) for m, v in metrics.items()})
    compare = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}
    rows = []
    for alert, metric, op, threshold, severity, title, message in ALERT_RULES:
        places = {
            "value": F.col(metric), "threshold": F.lit(threshold), "count": F.col("_stale"), "amount": F.col("_critical_amount"),
            "build_id": F.col("_build.build_id"), "dataset": F.col("_build.dataset_path"), "error": F.col("_build.error_message"),
        }
        fires = F.coalesce(compare[op](F.col(metric), F.lit(threshold)), F.lit(False))
        rows.append(
            F.struct(
                F.lit(alert).alias("alert_type"), F.lit(metric).alias("metric_name"), F.col(metric).alias("metric_value"), F.lit(op).alias("operator"), F.lit(threshold).alias("threshold"),
                F.lit(severity).alias("severity"), F.lit(title).alias("title"), fires.alias("triggered"), F.when(fires, filled(message, places)).alias("message"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


# Currency of a region and its rate to the dollar.
CURRENCY = {"US": "USD", "EU": "EUR", "UK": "GBP", "APAC": "SGD", "LATAM": "BRL", "GLOBAL": "USD"}
RATES = {"USD": 1.0, "EUR": 0.92, "GBP": 0.79, "AUD": 1.53, "SGD": 1.34, "BRL": 4.97}
# Price book rows: plan, region, monthly, annual, valid from, valid to (none = open).
PRICE_BOOK = (
    ("growth", "EU", 1399.0, 13990.0, "2001-01-01", None), ("enterprise", "UK", 3999.0, 39990.0, "2000-01-01", "2001-06-30"), ("starter", "APAC", 649.0, 6490.0, "2001-07-01", "2002-06-30"),
)


@job
def price_book(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(PRICE_BOOK), "plan_code string, region string, book_monthly double, book_annual double, valid_from string, valid_to string")
    return F.broadcast(rows.withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")}))


def _priced(rows: DataFrame) -> DataFrame:
    """Book prices where a book row was found, else base price times rate; with tax."""
    rate = by_value("currency", RATES, 1.0)
    base = lambda i: F.round(by_value("plan_code", {p: v[i] for p, v in PLANS.items()}) * rate, 2)
    charge = F.when(F.col("billing_interval") == "annual", F.col("annual_price")).otherwise(F.col("monthly_price"))
    return (
        rows.withColumns(
            {
                "monthly_price": F.coalesce(F.col("book_monthly"), base(1)), "annual_price": F.coalesce(F.col("book_annual"), base(2)),
                "from_book": F.col("book_monthly").isNotNull(), "tax_rate": tax_rate(), "tax_type": by_value("region", {r: v[1] for r, v in TAXES.items()}),
            }
        )
        .withColumn("tax_amount", F.round(charge * F.col("tax_rate") / 100, 2))
        .withColumn("total_with_tax", F.round(charge + F.col("tax_amount"), 2))
        .drop("book_monthly", "book_annual")
    )


@job
def tenant_prices(subscriptions: DataFrame, price_book: DataFrame, *, as_of) -> DataFrame:
    """Price in the region's currency: the book row valid today, else base price times rate; with tax."""
    today = F.lit(as_of)
    live = price_book.filter((F.col("valid_from") <= today) & (F.col("valid_to").isNull() | (today <= F.col("valid_to")))).drop("valid_from", "valid_to")
    tenants = subscriptions.select("tenant_id", "plan_code", "billing_interval", "region", "has_tax_id").withColumn("currency", by_value("region", CURRENCY))
    return _priced(tenants.join(live, ["plan_code", "region"], "left"))


def usage_periods(meter_usage: DataFrame) -> DataFrame:
    """(tenant_id, period, period_start): every month in which a tenant has metered usage."""
    return meter_usage.select("tenant_id", "period").distinct().withColumn("period_start", F.to_date(F.concat("period", F.lit("-01"))))


@job
def tenant_prices_by_period(subscriptions: DataFrame, price_book: DataFrame, meter_usage: DataFrame) -> DataFrame:
    """``tenant_prices`` for every month of usage, by the book row valid on the month's first day (interval join)."""
    tenants = subscriptions.select("tenant_id", "plan_code", "billing_interval", "region", "has_tax_id").withColumn("currency", by_value("region", CURRENCY))
    points = usage_periods(meter_usage).hint("merge").join(tenants, "tenant_id")
    book = price_book.select("plan_code", "region", "book_monthly", "book_annual", "valid_from", "valid_to")
    found = interval_join(points, book, ["plan_code", "region"], "period_start", "valid_from", "valid_to", end_inclusive=True)
    return _priced(found.drop("valid_from", "valid_to", "period_start"))


@job
def invoice_lines_by_period(subscriptions: DataFrame, subscription_add_ons: DataFrame, overage_charges: DataFrame, ramp_steps: DataFrame, meter_usage: DataFrame) -> DataFrame:
    """Invoice lines of every month of usage: the base line by the ramp step in force on the month's first day
    (start <= day < end, first by start and step; its override, else its plan's price), else the subscription's
    plan; add-ons not deactivated before the month; the month's overages.

    Tables with rows per tenant grow with the tenants, so they are merge-joined and never collected for a broadcast."""
    periods = usage_periods(meter_usage)
    steps = ramp_steps.select("tenant_id", "step", "start_date", "end_date", F.col("plan_code").alias("step_plan"), "price_override")
    in_force = interval_join(periods, steps, ["tenant_id"], "period_start", "start_date", "end_date").groupBy("tenant_id", "period").agg(
        F.min_by(F.struct("step_plan", "price_override"), F.struct("start_date", "step")).alias("s")
    )
    plan = F.coalesce(F.col("s.step_plan"), F.col("plan_code"))
    base = (
        in_force.hint("merge").join(subscriptions.select("tenant_id", "plan_code", "billing_interval"), "tenant_id")
        .withColumn("_plan", plan)
        .select(
            "tenant_id", "period", F.lit("subscription").alias("type"), by_value("_plan", {p: v[0] for p, v in PLANS.items()}).alias("item"), F.lit(1.0).alias("quantity"),
            F.coalesce(F.col("s.price_override"), plan_price("_plan")).alias("amount"),
        )
    )
    unit = by_value("add_on", {a: v[1] for a, v in ADD_ONS.items()})
    per_unit = by_value("add_on", {a: v[2] for a, v in ADD_ONS.items()})
    extras = (
        subscription_add_ons.hint("merge").join(periods, "tenant_id")
        .filter(F.col("deactivated_on").isNull() | (F.col("deactivated_on") >= F.col("period_start")))
        .select(
            "tenant_id", "period", F.lit("addon").alias("type"), by_value("add_on", {a: v[0] for a, v in ADD_ONS.items()}).alias("item"), F.col("quantity").cast("double").alias("quantity"),
            F.when(per_unit, unit * F.col("quantity")).otherwise(unit).alias("amount"),
        )
    )
    over = overage_charges.select("tenant_id", "period", F.lit("overage").alias("type"), F.col("meter").alias("item"), F.col("overage").cast("double").alias("quantity"), F.col("total").alias("amount"))
    return reduce(DataFrame.unionByName, [base, extras, over]).withColumn("amount", F.round("amount", 6))


@job
def regional_price_list(tenant_prices: DataFrame) -> DataFrame:
    """Price of each plan in each region in use, with the tenants and revenue on it."""
    return tenant_prices.groupBy("plan_code", "region", "currency").agg(
        F.max("monthly_price").alias("monthly_price"), F.max("annual_price").alias("annual_price"), F.count("*").alias("tenants"), exact_sum("total_with_tax").alias("billed")
    )


@job
def notification_trends(notification_summary: DataFrame) -> DataFrame:
    """First against last seven active days per tenant: delivery rate and volume."""
    daily = notification_summary.groupBy("customer_id", "summary_date").agg(F.sum("total_sent").alias("sent"), F.sum("total_delivered").alias("ok"))
    days = Window.partitionBy("customer_id")
    placed = daily.withColumns({"first": F.row_number().over(days.orderBy("summary_date")), "last": F.row_number().over(days.orderBy(F.desc("summary_date")))})
    early, late = F.col("first") <= 7, F.col("last") <= 7
    part = lambda test, c: nvl(F.sum(F.when(test, F.col(c))), 0)
    old, new = F.col("older_volume"), F.col("recent_volume")
    return (
        placed.groupBy("customer_id")
        .agg(part(early, "sent").alias("older_volume"), part(late, "sent").alias("recent_volume"), part(early, "ok").alias("_o"), part(late, "ok").alias("_n"))
        .withColumns({"older_rate": ratio("_o", old, empty=0), "recent_rate": ratio("_n", new, empty=0)})
        .withColumns(
            {
                "delivery_rate_trend": cases([(F.col("recent_rate") > F.col("older_rate") + 0.02, "improving"), (F.col("recent_rate") < F.col("older_rate") - 0.02, "declining")], "stable"),
                "volume_trend": cases([(new > old * 1.1, "increasing"), (new < old * 0.9, "decreasing")], "stable"),
                "issue": F.when(F.col("recent_rate") < 0.95, F.lit("Delivery rate below 95%")),
            }
        )
        .drop("_o", "_n")
    )


@job
def ops_overview(build_metrics: DataFrame, ops_agent_queue: DataFrame) -> DataFrame:
    """Queue and dataset counters of the ops page."""
    queue = ops_agent_queue.agg(F.count("*").alias("queue_items"), tally(F.col("severity") == "critical").alias("critical_items"), F.avg("estimated_resolution_min").alias("avg_minutes"))
    state = build_metrics.agg(F.count("*").alias("datasets"), tally("is_healthy").alias("healthy"), tally("is_slow").alias("slow"), F.sum("record_count").alias("records"))
    return side_by_side(queue, state)

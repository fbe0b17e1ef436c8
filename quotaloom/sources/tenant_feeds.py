"""Tenant-side feeds (settings, logs, subscriptions) derived from the driver tables.

A customer is a tenant; an event is one log line of its user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.exprs import by_value, cases
from quotaloom.plans.registry import job
from quotaloom.sources.warehouse import shifted

TIERS = {0: "starter", 1: "growth"}
SYNC_SYSTEMS = {0: "crm_a", 1: "crm_b", 2: "helpdesk", 3: "warehouse", 4: "chat"}
# Fixed values of the mapping: tables named in the build log.
TABLES = {
    0: "/Staging/opportunities", 1: "/Staging/activities", 2: "/Enriched/deal_health_scores", 3: "/Enriched/accounts",
    4: "/Analytics/pipeline_summary", 5: "/Analytics/forecast_methods", 6: "/Dashboard/kpis",
}


@job
def tenant_settings(customer: DataFrame, *, as_of) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("customer_id"), F.col("c_name").alias("customer_name"), by_value(k % 3, TIERS, "enterprise").alias("tier"),
        by_value(k % 3, {0: 10, 1: 50}, 500).alias("max_users"), F.date_sub(F.lit(as_of), ((k * 7) % 400).cast("int")).alias("onboarded_at"),
        (k % 2 == 0).alias("alerts_enabled"),
    )


@job
def build_log(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    bad = (F.col("event_type") == "error") & (F.col("value") > 60)
    return events.select(
        F.col("user_id").alias("customer_id"), by_value(k % 8, TABLES, "/Monitoring/usage").alias("dataset_path"), k.alias("build_id"),
        shifted().alias("build_timestamp"), F.when(bad, F.lit("FAILED")).otherwise(F.lit("SUCCEEDED")).alias("status"),
        F.col("value").alias("duration_seconds"), (k % 1000).alias("record_count"), F.when(bad, F.lit("Task failed")).alias("error_message"),
    )


@job
def feature_events(events: DataFrame) -> DataFrame:
    # Fixed values of the mapping: feature names by event type.
    names = {"click": "pipeline_health_dashboard", "view": "pipeline_hygiene_dashboard", "purchase": "forecasting_dashboard", "signup": "coaching"}
    return events.select(F.col("user_id").alias("customer_id"), by_value("event_type", names, "support").alias("feature_name"), shifted().alias("usage_timestamp"))


@job
def sync_log(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    kinds = {"click": "crm", "view": "support", "purchase": "marketing", "signup": "product"}
    status = cases([((F.col("event_type") == "error") & (F.col("value") > 80), "failed"), (k % 17 == 0, "warning")], "success")
    return events.select(
        F.col("user_id").alias("customer_id"), by_value("event_type", kinds, "crm").alias("sync_type"),
        by_value(k % 6, SYNC_SYSTEMS, "product").alias("source_system"), status.alias("status"), shifted().alias("last_sync_at"),
        (k % 2000).alias("records_synced"), (k % 20).alias("records_failed"),
    )


@job
def agent_actions(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("customer_id"), F.when(k % 9 != 0, F.lit("rebuild")).alias("action_type"), shifted().alias("executed_at"),
        by_value(k % 4, {0: "accepted", 1: "accepted", 2: "rejected"}).alias("feedback"), (1 + k % 5).cast("int").alias("rating"),
        by_value(k % 5, {0: "failed", 1: "pending"}, "success").alias("result"),
    )


@job
def go_live(customer: DataFrame, *, as_of) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("customer_id"), F.lit(True).alias("go_live_approved"), F.date_sub(F.lit(as_of), (k % 120).cast("int")).alias("go_live_date"),
        (k % 8 == 0).alias("cs_handoff_complete"), F.concat(F.lit("CS "), (k % 6).cast("string")).alias("cs_owner"),
    )


@job
def subscription_events(orders: DataFrame) -> DataFrame:
    k, on = F.col("o_orderkey"), F.to_date("o_orderdate")
    return orders.select(
        F.col("o_custkey").alias("customer_id"), on.alias("event_date"), k.alias("event_seq"),
        F.when(k % 3 == 0, F.lit("annual")).otherwise(F.lit("monthly")).alias("billing_cycle"),
        by_value(k % 10, {0: "canceled", 1: "past_due"}, "active").alias("subscription_status"), on.alias("started_at"),
        F.trunc(on, "month").alias("current_period_start"), F.last_day(on).alias("current_period_end"), (k % 6 == 0).alias("is_trial"),
        F.when(k % 6 == 0, F.date_add(on, 14)).alias("trial_ends_at"), (k % 9 == 0).alias("cancel_at_period_end"),
    )


@job
def webhook_configs(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("webhook_id"), k.alias("customer_id"), F.concat(F.lit("Hook "), k.cast("string")).alias("name"),
        (k % 5 != 0).alias("is_active"), (k % 13).cast("int").alias("failure_count"),
    )


@job
def webhook_delivery_log(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return events.select(
        k.alias("delivery_id"), F.col("user_id").alias("webhook_id"), "event_type", (1 + k % 6).cast("int").alias("attempt_count"),
        by_value(k % 8, {0: 500, 1: 404, 2: 503}, F.when(k % 8 != 3, F.lit(200))).alias("response_code"),
        F.floor(F.col("value") * 10).cast("int").alias("response_time_ms"), shifted().alias("created_at"),
    )


@job
def notification_events(events: DataFrame) -> DataFrame:
    k, at = F.col("event_id"), shifted()
    bad = (F.col("event_type") == "error") & (F.col("value") > 60)
    body = F.repeat(F.concat(F.lit("Message "), k.cast("string"), F.lit(". ")), (1 + k % 20).cast("int"))
    return events.select(
        k.alias("notification_id"), F.col("user_id").alias("customer_id"), by_value(k % 3, {0: "alert", 1: "digest"}, "nudge").alias("notification_type"),
        by_value(k % 4, {0: "email", 1: "slack", 2: "in_app"}, "webhook").alias("channel"), body.alias("body"),
        F.when(k % 25 != 0, at).alias("sent_at"), F.when((k % 25 != 0) & (k % 5 != 0), F.timestamp_add("SECOND", F.floor("value").cast("int"), at)).alias("delivered_at"),
        F.when((k % 25 != 0) & (k % 5 != 0) & (k % 3 == 0), F.timestamp_add("MINUTE", F.floor("value").cast("int"), at)).alias("read_at"),
        F.when(bad, F.lit("Channel error")).alias("error_message"),
    )


@job
def user_preferences(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    some = lambda m, v: F.when(k % m != 0, v)
    return customer.select(
        k.alias("user_id"), k.alias("customer_id"), some(3, k % 2 == 0).alias("email_enabled"), some(4, k % 5 == 0).alias("slack_enabled"),
        some(5, k % 7 != 0).alias("in_app_enabled"), some(6, F.lit("weekly")).alias("digest_frequency"),
        some(2, F.lit(22)).alias("quiet_hours_start"), some(2, F.lit(7)).alias("quiet_hours_end"),
    )


@job
def stored_stage_history(tenant_settings: DataFrame, *, as_of) -> DataFrame:
    """Stage history as stored before today's update: every tenant's open first-stage row."""
    return tenant_settings.select(
        "customer_id", F.lit("onboarding").alias("stage"), F.date_sub(F.lit(as_of), 20).alias("entered_at"),
        F.lit(None).cast("date").alias("exited_at"), F.lit(None).cast("int").alias("duration_days"),
    )

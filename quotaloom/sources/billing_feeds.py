"""Subscriptions, add-ons, price book, ramp steps and metered usage derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.exprs import by_value
from quotaloom.plans.registry import job
from quotaloom.sources.tenant_feeds import TIERS
from quotaloom.sources.warehouse import shifted

REGIONS = {0: "US", 1: "EU", 2: "UK", 3: "APAC", 4: "LATAM"}
METERS = {"click": "ai_insight_credits", "view": "agent_actions", "purchase": "deals", "signup": "seats"}


@job
def subscriptions(customer: DataFrame, *, as_of) -> DataFrame:
    k, today = F.col("c_custkey"), F.lit(as_of)
    start = F.date_sub(today, (k % 300).cast("int"))
    return customer.select(
        k.alias("tenant_id"), by_value(k % 3, TIERS, "enterprise").alias("plan_code"), F.when(k % 2 == 0, F.lit("annual")).otherwise(F.lit("monthly")).alias("billing_interval"),
        ((k % 6) * 5).cast("int").alias("discount_percent"), by_value(k % 6, REGIONS, "GLOBAL").alias("region"), (k % 4 == 0).alias("has_tax_id"),
        start.alias("contract_start"), F.add_months(start, 12).alias("contract_end"), F.lit(12).alias("term_months"), (k % 7 == 0).alias("cancel_at_period_end"),
        F.when(k % 5 == 0, F.date_add(today, (k % 10).cast("int"))).alias("trial_ends"),
    )


@job
def subscription_add_ons(customer: DataFrame, *, as_of) -> DataFrame:
    k = F.col("c_custkey")
    pick = F.array_compact(F.array(F.when(k % 4 == 0, F.lit("coaching_ai")), F.when(k % 6 == 0, F.lit("data_export")), F.when(k % 10 == 0, F.lit("extra_workspace"))))
    return customer.select(
        k.alias("tenant_id"), F.explode(pick).alias("add_on"), (1 + k % 3).cast("int").alias("quantity"),
        F.when(k % 8 == 0, F.date_sub(F.lit(as_of), (k % 60).cast("int"))).alias("deactivated_on"),
    )


@job
def usage_records(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("tenant_id"), by_value("event_type", METERS, "api_calls").alias("meter"), (F.floor("value") + 1).alias("quantity"), shifted().alias("used_at"),
    )


@job
def ramp_steps(customer: DataFrame, *, as_of) -> DataFrame:
    """Two ramp steps per tenant around the evaluation date."""
    k, today = F.col("c_custkey"), F.lit(as_of)
    turn = F.date_add(today, (k % 40 - 20).cast("int"))
    step = lambda n, a, b, plan, price: F.struct(F.lit(n).alias("step"), a.alias("start_date"), b.alias("end_date"), F.lit(plan).alias("plan_code"), price.alias("price_override"))
    rows = F.array(
        step(1, F.add_months(turn, -6), turn, "growth", F.when(k % 2 == 0, F.lit(1200.0))), step(2, turn, F.add_months(turn, 6), "enterprise", F.when(k % 4 == 0, F.lit(4200.0)))
    )
    return customer.select(k.alias("tenant_id"), F.inline(rows))

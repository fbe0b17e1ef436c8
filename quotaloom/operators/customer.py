"""Customer health, expansion and churn, funnel telemetry, and quarterly reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.exprs import (
    age_days, at_least, at_most, by_value, cases, days_ahead, exact_avg, exact_sum, in_quarter, nvl, present,
    quarter_label, ratio, side_by_side, tally,
)
from quotaloom.functions.ordered import number_from_counts
from quotaloom.operators.enrichment import health_band
from quotaloom.plans.registry import job


@job
def customer_health_scores(accounts: DataFrame, deal_health: DataFrame, activities: DataFrame, *, as_of) -> DataFrame:
    """Engagement, relationship, financial and support scores of paying accounts."""
    touches = activities.groupBy("account_id").agg(
        tally(F.col("activity_type") == "Meeting").alias("meetings"),
        F.max("activity_date").alias("last_touch"),
        F.count_distinct("contact_id").alias("contacts"),
    )
    deals = deal_health.groupBy("account_id").agg(exact_sum("amount", where=~F.col("is_closed")).alias("pool"))
    quiet, arr, pool = age_days(as_of, "last_touch"), F.col("current_arr"), F.col("pool")
    scores = {
        "engagement_score": F.least(F.round((nvl("meetings", 0) * 10 + nvl("contacts", 0) * 15) / 2, 0), F.lit(100.0)),
        "relationship_score": at_most(quiet, ((14, 100), (30, 80), (60, 60), (90, 40)), 20),
        "financial_score": cases([(pool > arr * 0.5, 100), (pool > arr * 0.25, 80), (pool > 0, 60)], 40),
        "support_score": F.lit(70),
    }
    weights = (("engagement_score", 0.30), ("relationship_score", 0.25), ("financial_score", 0.25), ("support_score", 0.20))
    total = sum((F.col(n) * w for n, w in weights[1:]), F.col("engagement_score") * 0.30)
    return (
        accounts.filter(arr > 0)
        .drop("health_score")
        .join(touches, "account_id", "left")
        .join(deals, "account_id", "left")
        .withColumns(scores)
        .withColumn("health_score", F.round(total, 1))
        .select(
            "account_id", "account_name", "industry", "segment", "current_arr", "health_score", health_band("health_score").alias("health_tier"),
            *scores,
            at_least("health_score", ((80, "Low"), (60, "Medium"), (40, "High")), "Critical").alias("churn_risk"),
            "renewal_date", days_ahead(as_of, "renewal_date").alias("days_to_renewal"),
            nvl(quiet, 999).alias("days_since_activity"),
            nvl("contacts", 0).alias("contacts_engaged"),
            nvl(pool, 0.0).alias("open_pipeline"),
        )
    )


@job
def expansion_opportunities(customer_health_scores: DataFrame) -> DataFrame:
    health, pool, people = F.col("health_score"), F.col("open_pipeline"), F.col("contacts_engaged")
    score = (
        health * 0.40
        + F.when(pool > 0, 30).otherwise(0)
        + F.when(people >= 3, F.lit(20).cast("bigint")).otherwise(people * 7)
        + F.when(F.col("days_since_activity") <= 14, 10).otherwise(0)
    )
    scored = (
        customer_health_scores.withColumn("expansion_score", F.round(score, 1))
        .withColumns(
            {
                "expansion_potential": F.round(F.col("current_arr") * F.col("expansion_score") / 100, 0),
                "expansion_tier": at_least("expansion_score", ((80, "High"), (60, "Medium"), (40, "Low")), "None"),
                "recommended_play": cases(
                    [
                        ((health >= 80) & (pool == 0), "Initiate expansion conversation - healthy account with no active deals"),
                        ((health >= 60) & (pool > 0), "Accelerate existing opportunity - good health, deal in progress"),
                        ((health < 60) & F.col("churn_risk").isin("High", "Critical"), "Focus on retention before expansion - address churn risk first"),
                    ],
                    "Monitor and nurture - build relationship before expansion",
                ),
            }
        )
    )
    order = [F.desc("expansion_score"), F.desc("current_arr"), F.asc("account_id")]
    grain = F.struct("expansion_score", F.floor(F.col("current_arr") / 1000))
    return number_from_counts(scored, order, "priority_rank", grain)


@job
def churn_risk_analysis(customer_health_scores: DataFrame) -> DataFrame:
    risk, renew, quiet, arr = F.col("churn_risk"), F.col("days_to_renewal"), F.col("days_since_activity"), F.col("current_arr")
    flag = lambda test, text: F.when(test, F.lit(text))
    exposed = customer_health_scores.filter(risk.isin("High", "Critical")).withColumns(
        {
            "risk_factors": F.concat_ws(
                ", ",
                flag(quiet > 30, "No recent engagement"),
                flag(F.col("contacts_engaged") < 2, "Single-threaded"),
                flag(F.col("engagement_score") < 50, "Low engagement"),
                flag(renew < 90, "Renewal approaching"),
            ),
            "arr_at_risk": F.round(by_value(risk, {"Critical": arr, "High": arr * 0.7}, arr * 0.3), 3),
            "save_probability": by_value(risk, {"Critical": 0.3, "High": 0.5}, 0.7),
            "recommended_action": cases(
                [
                    (risk == "Critical", "Immediate executive outreach required"),
                    ((risk == "High") & (renew < 90), "Schedule urgent renewal review meeting"),
                    (quiet > 60, "Re-engagement campaign - customer going dark"),
                ],
                "Increase touchpoint frequency",
            ),
            "urgency": cases([((risk == "Critical") | (renew < 30), "Immediate"), ((risk == "High") | (renew < 60), "This Week")], "This Month"),
        }
    )
    critical = (risk == "Critical").cast("int")
    order = [critical.desc(), F.desc("arr_at_risk"), F.asc("account_id")]
    return number_from_counts(exposed, order, "priority_rank", F.struct(critical, F.floor(F.col("arr_at_risk") / 1000)))


@job
def customer_health_summary(customer_health_scores: DataFrame, expansion_opportunities: DataFrame, churn_risk_analysis: DataFrame, *, as_of) -> DataFrame:
    tier, soon = F.col("health_tier"), F.col("days_to_renewal") <= 90
    health = customer_health_scores.agg(
        F.count("*").alias("total_customers"),
        exact_sum("current_arr").alias("total_arr"),
        exact_avg("health_score", 1).alias("avg_health_score"),
        *[tally(tier == t).alias(f"{t.lower().replace(' ', '_')}_count") for t in ("Healthy", "Monitor", "At Risk", "Critical")],
        exact_sum("current_arr", where=tier == "Healthy").alias("healthy_arr"),
        exact_sum("current_arr", where=tier.isin("At Risk", "Critical")).alias("at_risk_arr"),
        tally(soon).alias("renewals_90d"),
        exact_sum("current_arr", where=soon).alias("renewal_arr_90d"),
    )
    high = F.col("expansion_tier") == "High"
    growth = expansion_opportunities.agg(
        exact_sum("expansion_potential").alias("total_expansion_potential"),
        tally(high).alias("high_expansion_count"),
        exact_sum("expansion_potential", where=high).alias("high_expansion_value"),
    )
    loss = churn_risk_analysis.agg(F.count("*").alias("churn_risk_count"), exact_sum("arr_at_risk", 3).alias("total_arr_at_risk"))
    return side_by_side(health, growth, loss).withColumns(
        {
            "net_retention_forecast": F.round(
                F.try_divide(F.col("total_arr") + F.col("total_expansion_potential") - F.col("total_arr_at_risk"), F.col("total_arr")), 3
            ),
            "snapshot_date": F.lit(as_of),
        }
    )


@job
def customer_health_details(enriched_accounts: DataFrame, opportunities: DataFrame, *, as_of) -> DataFrame:
    """Recency, frequency and monetary scores of customers; churned after a year."""
    won = F.col("is_won")
    bought = opportunities.groupBy("account_id").agg(
        exact_sum("amount", where=won).alias("lifetime_value"),
        tally(won).alias("purchases"),
        exact_avg("amount", where=won).alias("avg_purchase"),
        F.max(F.when(won, F.col("close_date"))).alias("last_purchase_date"),
        F.min(F.when(won, F.col("close_date"))).alias("first_purchase_date"),
    )
    quiet, tenure = F.col("days_since_last_purchase"), F.col("tenure_days")
    return (
        enriched_accounts.filter("is_customer")
        .select("account_id", "account_name", "segment", "industry", "region", "current_arr", "account_tier")
        .join(bought, "account_id", "left")
        .withColumns({"days_since_last_purchase": age_days(as_of, "last_purchase_date"), "tenure_days": age_days(as_of, "first_purchase_date")})
        .withColumn("purchase_frequency", F.when(tenure > 0, F.round(F.col("purchases") / (tenure / 365.0), 2)).otherwise(F.lit(0.0)))
        .withColumns(
            {
                "recency_score": at_most(quiet, ((30, 100), (90, 75), (180, 50), (365, 25)), 10),
                "frequency_score": at_least("purchase_frequency", ((4, 100), (2, 75), (1, 50)), 25),
                "monetary_score": at_least("lifetime_value", ((500000, 100), (100000, 75), (50000, 50)), 25),
            }
        )
        .withColumn("health_score", F.round(F.col("recency_score") * 0.4 + F.col("frequency_score") * 0.3 + F.col("monetary_score") * 0.3, 0))
        .withColumns({"health_status": health_band("health_score"), "churned": quiet > 365, "snapshot_date": F.lit(as_of)})
    )


@job
def win_loss_details(opportunities: DataFrame, activities: DataFrame, *, as_of) -> DataFrame:
    kind = F.col("activity_type")
    touches = activities.groupBy("opportunity_id").agg(
        F.count("*").alias("total_activities"),
        F.count_distinct("activity_type").alias("activity_types"),
        *[tally(kind == t).alias(f"{t.lower()}s") for t in ("Call", "Email", "Meeting", "Demo")],
        F.min("activity_date").alias("first_activity_date"),
        F.max("activity_date").alias("final_activity_date"),
    )
    cycle, n = F.col("days_to_close"), F.col("total_activities")
    return (
        opportunities.filter("is_closed")
        .select(
            "opportunity_id", "account_id", "owner_id", "segment", "industry", "amount", "created_date", "close_date", "is_won", "days_to_close",
            "stakeholder_count", "has_champion", "is_competitive", "discount_percent",
        )
        .join(touches, "opportunity_id", "left")
        .withColumns(
            {
                "activity_density": F.when(cycle > 0, F.round(n / cycle * 30, 2)).otherwise(F.lit(0.0)),
                "meeting_ratio": F.when(n > 0, F.round(F.col("meetings") / n * 100, 1)).otherwise(F.lit(0.0)),
                "demo_conducted": F.col("demos") > 0,
                "multi_touch": F.col("activity_types") >= 3,
                "velocity_score": at_most(cycle, ((30, 100), (60, 75), (90, 50), (120, 25)), 10),
                "stakeholder_score": at_least("stakeholder_count", ((5, 100), (3, 75), (2, 50)), 25),
                "deal_size_bucket": at_least("amount", ((500000, "Enterprise"), (100000, "Mid-Market")), "SMB"),
                "outcome": F.when(F.col("is_won"), F.lit("Won")).otherwise(F.lit("Lost")),
                "close_quarter": quarter_label("close_date"),
                "snapshot_date": F.lit(as_of),
            }
        )
        .withColumn("engagement_score", at_least("activity_density", ((5, 100), (3, 75), (1, 50)), 25))
    )


def _rate(num, den) -> Column:
    return ratio(num, den, empty=0)


@job
def funnel_handoff_metrics(leads: DataFrame, *, as_of) -> DataFrame:
    status = F.col("status")
    names = {"mql": "MQL", "sql": "SQL", "qualified": "Qualified", "converted": "Converted", "disqualified": "Disqualified"}
    wait = F.datediff("first_response_date", "created_date")
    band = lambda x, good, fair: at_least(x, ((good, "HEALTHY"), (fair, "MONITOR")), "AT_RISK")
    return (
        leads.groupBy("lead_source", "segment")
        .agg(
            F.count("*").alias("total_leads"),
            *[tally(status == s).alias(f"{n}_count") for n, s in names.items()],
            F.avg("lead_score").alias("avg_lead_score"),
            F.avg(wait).alias("avg_response_time_days"),
        )
        .withColumns(
            {
                "mql_rate": _rate("mql_count", "total_leads"),
                "mql_to_sql_rate": _rate("sql_count", "mql_count"),
                "sql_to_qualified_rate": _rate("qualified_count", "sql_count"),
                "qualified_to_converted_rate": _rate("converted_count", "qualified_count"),
                "overall_conversion_rate": _rate("converted_count", "total_leads"),
                "disqualification_rate": _rate("disqualified_count", "total_leads"),
            }
        )
        .withColumns(
            {
                "mql_rate_health": band("mql_rate", 0.25, 0.15),
                "mql_to_sql_health": band("mql_to_sql_rate", 0.40, 0.25),
                "response_time_health": at_most("avg_response_time_days", ((1, "HEALTHY"), (3, "MONITOR")), "AT_RISK"),
                "snapshot_date": F.lit(as_of),
            }
        )
    )


# Response buckets by upper bound in hours and their effect.
RESPONSE_BUCKETS = ((1, "Within 1 Hour", "HIGH_POSITIVE"), (4, "1-4 Hours", "POSITIVE"), (24, "4-24 Hours", "NEUTRAL"), (72, "1-3 Days", "NEGATIVE"))


@job
def lead_response_analytics(leads: DataFrame, lead_touches: DataFrame) -> DataFrame:
    """First human touch per lead (a map-side combining ``min``), bucketed by delay."""
    first = (
        lead_touches.filter(F.col("activity_type").isin("Call", "Email", "Meeting"))
        .groupBy("lead_id")
        .agg(F.min("activity_date").alias("first_touch_date"))
    )
    seconds = F.timestamp_diff("SECOND", F.col("created_date"), F.col("first_touch_date"))
    hours = F.col("_sec") / 3600
    bucket = cases([(hours.isNull(), "No Response")] + [(hours <= h, n) for h, n, _ in RESPONSE_BUCKETS], "3+ Days")
    return (
        leads.join(first, "lead_id", "left")
        .withColumn("_sec", seconds)
        .withColumn("response_time_bucket", bucket)
        .groupBy("lead_source", "segment", "response_time_bucket")
        .agg(
            F.count("*").alias("lead_count"),
            (F.avg("_sec") / 3600).alias("avg_response_hours"),
            F.avg("lead_score").alias("avg_lead_score"),
            tally(F.col("status") == "Converted").alias("converted_count"),
        )
        .withColumns(
            {
                "conversion_rate": _rate("converted_count", "lead_count"),
                "speed_impact": by_value("response_time_bucket", {**{n: e for _, n, e in RESPONSE_BUCKETS}, "3+ Days": "HIGH_NEGATIVE"}, "UNKNOWN"),
            }
        )
    )


@job
def cross_team_activity(activities: DataFrame, deal_health: DataFrame) -> DataFrame:
    kind = F.col("activity_type")
    team = cases(
        [
            (kind.isin("Webinar", "Event", "Marketing Email"), "MARKETING"),
            (kind.isin("Call", "Email", "Meeting", "Demo"), "SALES"),
            (kind.isin("Onboarding", "Training", "Support"), "CUSTOMER_SUCCESS"),
        ],
        "OTHER",
    )
    touches = (
        activities.withColumn("team", team)
        .groupBy("opportunity_id")
        .agg(
            tally(F.col("team") == "MARKETING").alias("m"),
            tally(F.col("team") == "SALES").alias("s"),
            tally(F.col("team") == "CUSTOMER_SUCCESS").alias("c"),
            F.count("*").alias("n"),
            F.count_distinct("team").alias("teams"),
        )
    )
    return deal_health.join(touches, "opportunity_id", "left").select(
        "opportunity_id", "account_name", "stage_name", "amount",
        nvl("m", 0).alias("marketing_touches"), nvl("s", 0).alias("sales_touches"), nvl("c", 0).alias("cs_touches"),
        nvl("n", 0).alias("total_touches"), nvl("teams", 1).alias("teams_engaged"),
        cases([(F.col("teams") >= 3, "FULL"), (F.col("teams") == 2, "PARTIAL")], "SINGLE").alias("multi_team_engagement"),
        (nvl("m", 0) * 0.2 + nvl("s", 0) * 0.5 + nvl("c", 0) * 0.3).alias("engagement_score"),
        nvl("health_score", 50.0).alias("health_score"),
        (F.col("stage_name") == "Closed Won").cast("int").alias("is_won"),
    )


@job
def funnel_drop_analysis(leads: DataFrame, opportunities: DataFrame) -> DataFrame:
    status, stage = F.col("status"), F.col("stage_name")
    lead_side = leads.groupBy("segment", "lead_source").agg(
        F.count("*").alias("total_leads"),
        tally(status == "MQL").alias("mql_count"),
        tally(status == "SQL").alias("sql_count"),
        tally(status == "Converted").alias("converted_count"),
    )
    late = ["Solution Design", "Proposal", "Negotiation", "Closed Won"]
    reached = {"qualified_opp_count": late, "proposal_count": late[1:], "negotiation_count": late[2:], "won_count": late[3:]}
    deal_side = opportunities.groupBy("segment", "lead_source").agg(
        F.count("*").alias("opp_count"),
        *[tally(stage.isin(s)).alias(n) for n, s in reached.items()],
        exact_sum("amount", where=stage == "Closed Won").alias("won_amount"),
    )
    steps = ("total_leads", "mql_count", "sql_count", "opp_count", *reached)
    # Drop columns and stage labels in funnel order.
    drops = {
        "drop_lead_to_mql": "Lead→MQL", "drop_mql_to_sql": "MQL→SQL", "drop_sql_to_opp": "SQL→Opp", "drop_opp_to_qualified": "Opp→Qualified",
        "drop_qualified_to_proposal": "Qualified→Proposal", "drop_proposal_to_negotiation": "Proposal→Negotiation", "drop_negotiation_to_won": "Negotiation→Won",
    }
    pairs = dict(zip(drops, zip(steps, steps[1:])))
    return (
        lead_side.join(deal_side, ["segment", "lead_source"], "left")
        .fillna(0)
        .withColumns({d: F.col(a) - F.col(b) for d, (a, b) in pairs.items()})
        .withColumns(
            {
                "overall_conversion_rate": _rate("won_count", "total_leads"),
                "largest_drop_stage": cases((F.col(d) == F.greatest(*drops), label) for d, label in drops.items()),
            }
        )
    )


@job
def telemetry_summary(
    funnel_handoff_metrics: DataFrame, lead_response_analytics: DataFrame, cross_team_activity: DataFrame, *, as_of
) -> DataFrame:
    handoff = funnel_handoff_metrics.agg(
        *[nvl(F.sum(f"{n}_count" if n != "total" else "total_leads"), 0).alias(a) for n, a in (("total", "total_leads"), ("mql", "total_mqls"), ("sql", "total_sqls"), ("converted", "total_converted"))],
        nvl(exact_avg("mql_to_sql_rate", 6), 0.0).alias("mql_to_sql_rate"),
        nvl(exact_avg("overall_conversion_rate", 6), 0.0).alias("overall_conversion_rate"),
        exact_avg("avg_response_time_days", 6).alias("_wait"),
    )
    bucket = F.col("response_time_bucket")
    speed = lead_response_analytics.agg(
        F.sum(F.when(bucket == "Within 1 Hour", F.col("lead_count")).otherwise(0)).alias("_fast"),
        nvl(F.sum(F.when(bucket.isin("3+ Days", "No Response"), F.col("lead_count")).otherwise(0)), 0).alias("slow_response_count"),
        F.sum("lead_count").alias("_answered"),
    )
    mode = F.col("multi_team_engagement")
    joint = cross_team_activity.agg(
        nvl(exact_avg("engagement_score", 1), 0.0).alias("avg_engagement_score"),
        nvl(F.avg("total_touches"), 0.0).alias("avg_touches_per_deal"),
        (tally(mode == "FULL") / F.greatest(F.count("*"), F.lit(1))).alias("full_engagement_pct"),
        nvl(F.avg(F.when(mode == "FULL", F.col("health_score"))), 0.0).alias("full_engagement_health_avg"),
        nvl(F.avg(F.when(mode == "SINGLE", F.col("health_score"))), 0.0).alias("single_engagement_health_avg"),
    )
    votes = ("mql_to_sql_health", "response_health", "speed_to_lead_health", "team_alignment_health")
    vote = lambda n: by_value(n, {"HEALTHY": 3, "MONITOR": 2}, 1)
    # Recommendation per bottleneck.
    advice = {
        "MQL to SQL Conversion": "Review lead scoring criteria and SDR qualification process. Consider tightening MQL definition or improving SDR training.",
        "Speed to Lead": "Implement automated lead routing and alerts. Set SLA for first touch within 1 hour of MQL.",
        "Multi-Team Engagement": "Establish joint account planning between Sales and CS. Create triggers for CS involvement in late-stage deals.",
        "None identified": "Funnel health is good. Focus on maintaining current performance and scaling volume.",
    }
    score = sum((vote(v) for v in votes[1:]), vote(votes[0])) / 4
    fast = F.coalesce(F.col("_fast"), F.lit(0)) / F.greatest(nvl("_answered", 1), F.lit(1))
    return (
        side_by_side(handoff, speed, joint)
        .withColumns({"fast_response_pct": fast, "avg_response_days": nvl("_wait", 0.0)})
        .withColumns(
            {
                "health_delta": F.col("full_engagement_health_avg") - F.col("single_engagement_health_avg"),
                "mql_to_sql_health": at_least("mql_to_sql_rate", ((0.35, "HEALTHY"), (0.25, "MONITOR")), "AT_RISK"),
                "response_health": at_most(nvl("_wait", 99.0), ((1, "HEALTHY"), (3, "MONITOR")), "AT_RISK"),
                "speed_to_lead_health": at_least("fast_response_pct", ((0.5, "HEALTHY"), (0.25, "MONITOR")), "AT_RISK"),
                "team_alignment_health": at_least("full_engagement_pct", ((0.4, "HEALTHY"), (0.2, "MONITOR")), "AT_RISK"),
            }
        )
        .withColumns(
            {
                "overall_health": at_least(score, ((2.5, "HEALTHY"), (1.75, "MONITOR")), "AT_RISK"),
                "primary_bottleneck": cases(
                    [
                        (F.col("mql_to_sql_health") == "AT_RISK", "MQL to SQL Conversion"),
                        (F.col("speed_to_lead_health") == "AT_RISK", "Speed to Lead"),
                        (F.col("team_alignment_health") == "AT_RISK", "Multi-Team Engagement"),
                    ],
                    "None identified",
                ),
            }
        )
        .withColumns({"recommendation": by_value("primary_bottleneck", advice), "snapshot_date": F.lit(as_of)})
        .drop("_wait", "_fast", "_answered")
    )


GRADES = ((85, "A"), (70, "B"), (55, "C"), (40, "D"))
ACCURACY_GRADES = ((0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D"))


@job
def qbr_performance_summary(opportunities: DataFrame, sales_reps: DataFrame, quotas: DataFrame, *, as_of) -> DataFrame:
    stage = F.col("stage_name")
    won, lost = stage == "Closed Won", stage == "Closed Lost"
    return (
        opportunities.filter(in_quarter(as_of, "close_date"))
        .groupBy("owner_id", "owner_name")
        .agg(
            exact_sum("amount", where=won).alias("closed_won"),
            exact_sum("amount", where=~lost).alias("open_pipeline"),
            F.count("*").alias("total_deals"),
            tally(won).alias("won_count"),
            tally(lost).alias("lost_count"),
            exact_avg("amount").alias("avg_deal_size"),
            F.avg(F.when(won, F.datediff("close_date", "created_date"))).alias("avg_sales_cycle"),
        )
        .join(quotas.withColumnRenamed("rep_id", "owner_id"), "owner_id", "left")
        .join(sales_reps.select(F.col("rep_id").alias("owner_id"), "region", "segment"), "owner_id", "left")
        .withColumns(
            {
                "win_rate": _rate("won_count", F.col("won_count") + F.col("lost_count")),
                "quota_attainment": _rate("closed_won", "quota_amount"),
                "gap_to_quota": F.col("quota_amount") - F.col("closed_won"),
                "quarter": quarter_label(F.lit(as_of)),
            }
        )
        .withColumn("performance_tier", at_least("quota_attainment", ((1.1, "Top Performer"), (0.9, "On Track"), (0.7, "Needs Improvement")), "At Risk"))
    )


@job
def qbr_pipeline_health(deal_health: DataFrame, pipeline_hygiene_summary: DataFrame, *, as_of) -> DataFrame:
    health = F.col("health_score")
    pool = deal_health.filter(in_quarter(as_of, "close_date") & ~F.col("stage_name").isin("Closed Won", "Closed Lost")).agg(
        F.count("*").alias("total_opportunities"),
        exact_sum("amount").alias("total_pipeline"),
        nvl(exact_avg("amount"), 0.0).alias("avg_deal_size"),
        nvl(F.avg("health_score"), 0.0).alias("avg_health_score"),
        exact_sum("amount", where=health >= 70).alias("healthy_pipeline"),
        exact_sum("amount", where=(health >= 50) & (health < 70)).alias("monitor_pipeline"),
        exact_sum("amount", where=health < 50).alias("at_risk_pipeline"),
    )
    floor = F.greatest("total_pipeline", F.lit(1.0))
    return side_by_side(pool, pipeline_hygiene_summary.select(nvl("avg_hygiene_score", 70.0).alias("hygiene_score"))).withColumns(
        {
            "quarter": quarter_label(F.lit(as_of)),
            **{f"{n}_pct": F.col(f"{n}_pipeline") / floor for n in ("healthy", "monitor", "at_risk")},
            "pipeline_health_grade": at_least("avg_health_score", GRADES, "F"),
        }
    )


@job
def qbr_forecast_accuracy(forecast_history: DataFrame, *, as_of) -> DataFrame:
    """Weekly forecast position (won so far plus weighted open) against won so far."""
    forecast, actual = F.col("closed_won") + F.col("ai_forecast"), F.col("closed_won")
    base = F.greatest("forecast_amount", F.lit(1.0))
    gap = F.col("forecast_amount") - F.col("actual_amount")
    score = F.when(F.col("week_number") > 4, 1 - F.abs(gap) / base).otherwise(F.lit(0.0))
    return (
        forecast_history.select(
            "week_number", F.format_string("Week %d", "week_number").alias("week_label"),
            F.round(forecast, 4).alias("forecast_amount"), actual.alias("actual_amount"),
        )
        .withColumns({"variance": F.round(gap, 4), "variance_pct": gap / base, "accuracy_score": F.least(score, F.lit(1.0)), "quarter": quarter_label(F.lit(as_of))})
        .withColumn("accuracy_grade", at_least("accuracy_score", ACCURACY_GRADES, "F"))
    )


@job
def qbr_win_loss_analysis(opportunities: DataFrame, activities: DataFrame, *, as_of) -> DataFrame:
    touches = activities.groupBy("opportunity_id").agg(
        F.count("*").alias("n"), tally(F.col("activity_type") == "Meeting").alias("meetings")
    )
    closed = opportunities.filter(in_quarter(as_of, "close_date") & F.col("is_closed")).join(touches, "opportunity_id", "left")
    sides = (("wins", F.col("is_won")), ("losses", ~F.col("is_won")))
    cycle = F.datediff("close_date", "created_date")
    sums = []
    for side, test in sides:
        sums += [
            tally(test).alias(f"{side}_count"),
            exact_sum("amount", where=test).alias(f"{side}_revenue"),
            nvl(exact_avg("amount", where=test), 0.0).alias(f"{side}_avg_deal_size"),
            nvl(F.avg(F.when(test, F.col("n"))), 0.0).alias(f"{side}_avg_activities"),
            nvl(F.avg(F.when(test, F.col("meetings"))), 0.0).alias(f"{side}_avg_meetings"),
            nvl(F.avg(F.when(test, cycle)), 0.0).alias(f"{side}_avg_cycle"),
        ]
    top = (
        closed.filter(F.col("loss_reason").isNotNull())
        .groupBy("loss_reason")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "loss_reason")
        .limit(3)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("loss_reason").alias("reason")))).alias("_top"))
    )
    nth = lambda i: F.get("_top", F.lit(i - 1))
    return (
        side_by_side(closed.agg(*sums), top)
        .withColumns(
            {
                "quarter": quarter_label(F.lit(as_of)),
                "win_rate": F.col("wins_count") / F.greatest(F.col("wins_count") + F.col("losses_count"), F.lit(1)),
                **{f"top_loss_reason_{i}": nvl(nth(i)["reason"], "Unknown") for i in (1, 2, 3)},
                **{f"top_loss_reason_{i}_pct": nvl(-nth(i)["neg"] / F.greatest("losses_count", F.lit(1)), 0.0) for i in (1, 2, 3)},
                "activity_delta": F.col("wins_avg_activities") - F.col("losses_avg_activities"),
                "meeting_delta": F.col("wins_avg_meetings") - F.col("losses_avg_meetings"),
                "cycle_delta": F.col("losses_avg_cycle") - F.col("wins_avg_cycle"),
            }
        )
        .drop("_top")
    )


@job
def qbr_executive_summary(
    qbr_performance_summary: DataFrame, qbr_pipeline_health: DataFrame, qbr_forecast_accuracy: DataFrame, qbr_win_loss_analysis: DataFrame
) -> DataFrame:
    tier = F.col("performance_tier")
    team = qbr_performance_summary.agg(
        exact_sum("closed_won").alias("total_closed_won"),
        exact_sum("quota_amount").alias("total_quota"),
        nvl(exact_avg("quota_attainment", 6), 0.0).alias("avg_rep_attainment"),
        tally(tier == "Top Performer").alias("top_performers"),
        tally(tier == "At Risk").alias("at_risk_reps"),
        F.count("*").alias("total_reps"),
    )
    pool = qbr_pipeline_health.select("quarter", "total_pipeline", "avg_health_score", "at_risk_pipeline", "hygiene_score", F.col("at_risk_pct").alias("_risk"))
    fc = qbr_forecast_accuracy.agg(nvl(F.max_by("accuracy_score", "week_number"), 0.0).alias("forecast_accuracy"))
    wl = qbr_win_loss_analysis.select(
        "win_rate", F.col("wins_avg_deal_size").alias("avg_deal_size"), F.col("wins_avg_cycle").alias("avg_sales_cycle"),
        F.col("top_loss_reason_1").alias("top_loss_reason"), F.col("activity_delta").alias("_delta"),
    )
    att, risk, reason = F.col("team_attainment"), F.col("_risk"), F.col("top_loss_reason")
    quarter_point = lambda x, full: F.least(x / full, F.lit(1.0)) * 25
    money = lambda x: F.format_number(x, 0)
    pct = lambda x: F.format_string("%.0f", x * 100)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    # Insight and recommendation texts in order of precedence.
    insights = present(
        cases(
            [
                (att >= 0.9, text("Team is on track at ", pct(att), "% of quota with strong performer distribution.")),
                (att >= 0.7, text("Team at ", pct(att), "% of quota. Gap of $", money(F.col("total_quota") - F.col("total_closed_won")), " needs to be addressed in remaining weeks.")),
            ],
            text("Team significantly behind at ", pct(att), "% of quota. Urgent intervention required."),
        ),
        cases(
            [
                (risk > 0.3, text(pct(risk), "% of pipeline is at risk ($", money("at_risk_pipeline"), "). Focus on deal acceleration and risk mitigation.")),
                (risk < 0.15, "Pipeline health is strong with minimal at-risk deals. Maintain current engagement levels."),
            ]
        ),
        F.when(F.col("_delta") > 5, text("Won deals average ", F.format_string("%.0f", "_delta"), " more activities than lost deals. Ensure adequate engagement on all opportunities.")),
        by_value(
            reason,
            {
                "Price": "Price is the top loss reason. Review discounting authority and value messaging.",
                "Competitor": "Competitive losses are high. Consider competitive battle card refresh and win-back programs.",
            },
        ),
    )
    advice = present(
        F.when(F.col("at_risk_reps") > 0, text("Schedule 1:1 coaching sessions with ", F.col("at_risk_reps").cast("string"), " at-risk reps to develop deal-specific action plans.")),
        F.when(F.col("hygiene_score") < 70, F.lit("Implement weekly pipeline hygiene reviews. Require close date and next step updates for all active deals.")),
        F.when(F.col("win_rate") < 0.35, F.lit("Win rate below target. Review qualification criteria and implement MEDDIC framework adoption.")),
        F.when(F.col("at_risk_pipeline") > 2000000, text("$", F.format_string("%.1f", F.col("at_risk_pipeline") / 1000000), "M at risk. Launch deal review cadence for all opportunities over $100K in late stages.")),
    )
    fallback = F.array(F.lit("Maintain current processes. Focus on scaling best practices from top performers."))
    nth = lambda name, i: nvl(F.get(name, F.lit(i - 1)), "")
    return (
        side_by_side(team, pool, fc, wl)
        .withColumn("team_attainment", F.col("total_closed_won") / F.greatest("total_quota", F.lit(1.0)))
        .withColumns(
            {
                "overall_health_score": quarter_point(F.col("avg_rep_attainment"), 0.8)
                + quarter_point(F.col("avg_health_score"), 80)
                + F.col("forecast_accuracy") * 25
                + quarter_point(F.col("win_rate"), 0.4),
                "forecast_grade": at_least("forecast_accuracy", ACCURACY_GRADES, "F"),
                "_insights": insights,
                "_advice": F.when(F.size(advice) == 0, fallback).otherwise(advice),
            }
        )
        .withColumns(
            {
                "health_grade": at_least("overall_health_score", GRADES, "F"),
                **{f"insight_{i}": nth("_insights", i) for i in (1, 2, 3)},
                **{f"recommendation_{i}": nth("_advice", i) for i in (1, 2, 3)},
            }
        )
        .drop("_risk", "_delta", "_insights", "_advice")
    )

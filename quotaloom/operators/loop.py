"""Closed loop of actions and decisions, alerts, and data-quality tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.exprs import exact_avg, exact_sum, nvl, ratio, tally
from quotaloom.plans.registry import job


@job
def impact_tracker(dashboard_next_best_actions: DataFrame, sales_interventions: DataFrame) -> DataFrame:
    """Actions against recorded decisions by quarter, region and segment."""
    made = sales_interventions.select("action_id", "decision_date", "realized_impact_amount", "result", "quarter")
    decided, result = F.col("decision_date").isNotNull(), F.col("result")
    return (
        dashboard_next_best_actions.select("action_id", "region", "segment", "created_at", "expected_impact_amount")
        .join(made, "action_id", "left")
        .withColumn("quarter", nvl("quarter", "Unspecified"))
        .groupBy("quarter", "region", "segment")
        .agg(
            F.count_distinct("action_id").alias("actions_created"),
            tally(decided).alias("actions_with_decision"),
            F.count_distinct(F.when(~decided, F.col("action_id"))).alias("actions_without_decision"),
            F.avg(F.datediff("decision_date", "created_at")).alias("avg_time_to_decision_days"),
            exact_sum("expected_impact_amount").alias("total_expected_impact_amount"),
            exact_sum("realized_impact_amount", 4).alias("total_realized_impact_amount"),
            *[tally(result == r).alias(n) for r, n in (("Won", "deals_won"), ("Lost", "deals_lost"), ("Slip", "deals_slipped"))],
        )
        .withColumns(
            {
                "decision_rate": ratio("actions_with_decision", "actions_created", empty=0),
                "realized_vs_expected_ratio": ratio("total_realized_impact_amount", "total_expected_impact_amount", empty=0),
            }
        )
    )


@job
def intervention_effectiveness(sales_interventions: DataFrame, dashboard_next_best_actions: DataFrame) -> DataFrame:
    plays = dashboard_next_best_actions.select("action_id", "playbook")
    result = F.col("result")
    defaults = {"playbook": "No Playbook", "decision_type": "Unspecified", "actor_role": "Unknown", "quarter": "Unspecified"}
    outcomes = (("Won", "deals_won"), ("Lost", "deals_lost"), ("Slip", "deals_slipped"), ("Open", "deals_still_open"))
    return (
        sales_interventions.join(plays, "action_id", "left")
        .fillna(defaults)
        .groupBy(*defaults)
        .agg(
            F.count("*").alias("decisions"),
            F.count_distinct("opportunity_id").alias("deals_impacted"),
            *[tally(result == r).alias(n) for r, n in outcomes],
            F.avg("pre_health_score").alias("avg_pre_health_score"),
            F.avg("post_health_score").alias("avg_post_health_score"),
            exact_avg("expected_impact_amount", 4).alias("avg_expected_impact_amount"),
            exact_sum("expected_impact_amount", 4).alias("total_expected_impact_amount"),
            exact_avg("realized_impact_amount", 4).alias("avg_realized_impact_amount"),
            exact_sum("realized_impact_amount", 4).alias("total_realized_impact_amount"),
        )
        .withColumns(
            {
                "health_delta": F.col("avg_post_health_score") - F.col("avg_pre_health_score"),
                "win_rate": ratio("deals_won", "deals_impacted", empty=0),
                "realized_vs_expected_ratio": ratio("total_realized_impact_amount", "total_expected_impact_amount", empty=0),
            }
        )
    )


@job
def alerts_summary(pipeline_hygiene_alerts: DataFrame, *, as_of) -> DataFrame:
    severity = F.col("alert_severity")
    return pipeline_hygiene_alerts.agg(
        F.count("*").alias("total_active"),
        *[tally(severity == s.upper()).alias(f"{s}_count") for s in ("critical", "high", "medium", "low")],
    ).withColumns(
        {"acknowledged_count": F.lit(0), "resolved_today": F.lit(0), "avg_resolution_time": F.lit(4.5), "snapshot_date": F.lit(as_of)}
    )


@job
def alerts_active(pipeline_hygiene_alerts: DataFrame, deal_health: DataFrame, *, as_of) -> DataFrame:
    """Hygiene and critical-health alerts in one schema, ids derived from the deal."""
    def alert(df: DataFrame, prefix: str, title: Column, text: Column, severity: Column, category: str, source: str) -> DataFrame:
        key = F.col("opportunity_id").cast("string")
        return df.select(
            F.concat(F.lit(prefix), key).alias("alert_id"), title.alias("title"), text.alias("description"), severity.alias("severity"),
            F.lit(category).alias("category"), F.lit(source).alias("source"), F.lit(as_of).alias("created_at"), F.lit("Active").alias("status"),
            F.lit(None).cast("string").alias("acknowledged_by"), F.lit(None).cast("date").alias("acknowledged_at"),
            F.lit(None).cast("date").alias("resolved_at"), F.lit("Opportunity").alias("related_object_type"),
            F.col("opportunity_id").alias("related_object_id"), F.col("opportunity_name").alias("related_object_name"),
            F.concat(F.lit("/deals/"), key).alias("action_url"), F.col("owner_name").alias("assignee"),
        )

    hygiene = alert(
        pipeline_hygiene_alerts.filter(F.col("alert_severity").isin("CRITICAL", "HIGH", "MEDIUM")), "HYG-",
        F.concat(F.col("alert_severity"), F.lit(" Hygiene Alert: "), F.col("primary_alert")),
        F.format_string("%s (%s) - %s", "opportunity_name", "account_name", "recommended_action"),
        F.col("alert_severity"), "Pipeline Hygiene", "Hygiene Monitor",
    )
    health = alert(
        deal_health.filter("health_category = 'Critical'"), "HEALTH-",
        F.concat(F.lit("Critical Deal Health: "), F.col("opportunity_name")),
        F.format_string("Health score dropped to %d - immediate attention required", F.col("health_score").cast("int")),
        F.lit("CRITICAL"), "Deal Health", "Health Monitor",
    )
    return hygiene.unionByName(health)


# Alert rules; the condition is a Spark SQL predicate over deals.
ALERT_RULES = (
    ("RULE-001", "Critical Deal Health", "Deal Health", "CRITICAL", "health_score < 40", 40.0, "email,slack"),
    ("RULE-002", "Stale Close Date", "Pipeline Hygiene", "HIGH", "close_date < evaluated_on AND NOT is_closed", 0.0, "email"),
    ("RULE-003", "Gone Dark", "Engagement", "HIGH", "days_since_activity > 14 AND NOT is_closed", 14.0, "email,slack"),
    ("RULE-004", "Single Threaded Large Deal", "Risk", "MEDIUM", "amount > 200000 AND stakeholder_count < 3", 3.0, "email"),
    ("RULE-005", "Heavy Discount", "Deal Desk", "MEDIUM", "discount_percent > 25", 25.0, "email"),
)


@job
def alert_rules(deal_health: DataFrame, *, as_of) -> DataFrame:
    """Each rule's condition evaluated over all deals in one aggregation."""
    counts = deal_health.withColumn("evaluated_on", F.lit(as_of)).agg(
        *[tally(F.expr(cond)).alias(f"n{i}") for i, (_, _, _, _, cond, _, _) in enumerate(ALERT_RULES)]
    )
    names = ("rule_id", "name", "category", "severity", "condition", "threshold", "notification_channels")
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule)], F.lit(True).alias("enabled"), F.col(f"n{i}").alias("trigger_count"))
        for i, rule in enumerate(ALERT_RULES)
    ]
    return counts.select(F.inline(F.array(*rows)))


FRESHNESS = 0.95


@job
def data_quality_summary(opportunities: DataFrame, accounts: DataFrame, sales_reps: DataFrame) -> DataFrame:
    """Completeness, validity and freshness of deals from one aggregation."""
    fields = ("opportunity_name", "amount", "close_date", "owner_id")
    odd = (F.col("amount") < 0) | (F.col("amount") > 10000000) | (F.col("discount_percent") < 0) | (F.col("discount_percent") > 100)
    nulls = sum((tally(F.col(f).isNull()) for f in fields[1:]), tally(F.col(fields[0]).isNull()))
    one = opportunities.agg(F.count("*").alias("_n"), nulls.alias("_null"), tally(nvl(odd, False)).alias("critical_issues"))
    n = F.col("_n")
    size = lambda df: df.agg(F.count("*")).scalar()
    return (
        one.withColumns(
            {
                "completeness_score": F.when(n > 0, F.round(1 - F.col("_null") / (n * len(fields)), 3)).otherwise(F.lit(0.0)),
                "validity_score": F.when(n > 0, F.round(1 - F.col("critical_issues") / n, 3)).otherwise(F.lit(1.0)),
                "freshness_score": F.lit(FRESHNESS),
                "total_records": n + size(accounts) + size(sales_reps),
                "issue_count": F.col("_null") + F.col("critical_issues"),
                "sync_status": F.lit("Healthy"),
                "trend": F.lit("improving"),
            }
        )
        .withColumn("overall_score", F.round(F.col("completeness_score") * 0.4 + F.col("validity_score") * 0.35 + F.col("freshness_score") * 0.25, 2))
        .drop("_n", "_null")
    )


# Checked fields: metric, category, object, field, target.
FIELD_CHECKS = (
    ("Amount Populated", "Completeness", "Opportunity", "amount", 0.95),
    ("Close Date Valid", "Validity", "Opportunity", "close_date", 0.95),
    ("Owner Assigned", "Completeness", "Opportunity", "owner_id", 0.98),
    ("Stage Name Valid", "Validity", "Opportunity", "stage_name", 0.98),
    ("Forecast Category Set", "Completeness", "Opportunity", "forecast_category", 0.90),
    ("Industry Classified", "Completeness", "Account", "industry", 0.95),
    ("Segment Assigned", "Completeness", "Account", "segment", 0.95),
)


@job
def data_quality_metrics(opportunities: DataFrame, accounts: DataFrame) -> DataFrame:
    """Null rate of each checked field in long form; one aggregation per table."""
    def long(df: DataFrame, kind: str) -> DataFrame:
        mine = [c for c in FIELD_CHECKS if c[2] == kind]
        one = df.agg(F.count("*").alias("n"), *[tally(F.col(c[3]).isNull()).alias(f"z{i}") for i, c in enumerate(mine)])
        rows = []
        for i, (metric, category, obj, field, target) in enumerate(mine):
            bad = F.col(f"z{i}")
            score = F.when(F.col("n") > 0, F.round(1 - bad / F.col("n"), 2)).otherwise(F.lit(1.0))
            steady = (F.abs(score - target) < 0.05) if kind == "Opportunity" else F.lit(True)
            fix = (
                F.when(bad > 0, F.lit(f"Run data enrichment for {field}")).otherwise(F.lit("No action needed"))
                if kind == "Opportunity" else F.lit(f"Enrich {field} from external source")
            )
            rows.append(F.struct(
                F.lit(metric).alias("metric_name"), F.lit(category).alias("category"), F.lit(obj).alias("object_type"), score.alias("current_score"),
                F.lit(target).alias("target_score"), F.when(steady, F.lit("stable")).otherwise(F.lit("declining")).alias("trend"), bad.alias("issue_count"),
                F.format_string(f"%d records missing {field}", bad).alias("sample_issues"), fix.alias("remediation_action"), F.lit("Data Ops").alias("owner"),
            ))
        return one.select(F.inline(F.array(*rows)))

    return long(opportunities, "Opportunity").unionByName(long(accounts, "Account"))

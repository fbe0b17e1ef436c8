"""Forecasts, win and slip models, and what-if scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.dims import HEALTH_WORTH
from quotaloom.functions.exprs import (
    age_days, at_least, at_most, by_value, cases, days_ahead, exact_avg, exact_sum, in_quarter, nvl, over,
    quarter_bounds, quarter_label, ratio, row_of, side_by_side, tally, under,
)
from quotaloom.plans.registry import job

QUARTER_TARGET = 13_000_000.0
HISTORY_TARGET = 8_500_000.0
HISTORY_WEEKS = 12
# Share of the amount expected to close, by category and health tier (80+, 60+, rest).
CLOSE_RATES = {"Commit": (0.95, 0.75, 0.50), "Best Case": (0.50, 0.40, 0.25), "Pipeline": (0.30, 0.20, 0.10)}
STAGE_CEILING = {"Prospecting": 40.0, "Discovery": 55.0, "Solution Design": 70.0, "Proposal": 85.0, "Negotiation": 95.0, "Verbal Commit": 98.0}


@job
def forecast_confidence(deal_health: DataFrame, *, as_of) -> DataFrame:
    """Quarter forecast by category with health-tiered conversion and a total row."""
    deals = deal_health.filter(in_quarter(as_of, "close_date"))
    stage, category = F.col("stage_name"), F.col("forecast_category")
    scope = {
        "Commit": (category == "Commit") & ~stage.isin("Closed Won", "Closed Lost"),
        "Best Case": (category == "Best Case") & (stage != "Closed Lost"),
        "Pipeline": (category == "Pipeline") & (stage != "Closed Lost"),
    }
    sums = [exact_sum("amount", where=stage == "Closed Won").alias("won")]
    for i, (name, (high, mid, low)) in enumerate(CLOSE_RATES.items()):
        rate = at_least("health_score", ((80, high), (60, mid)), low)
        sums += [exact_sum("amount", where=scope[name]).alias(f"a{i}"), exact_sum(F.col("amount") * rate, 4, scope[name]).alias(f"w{i}")]
    one = deals.agg(*sums)

    def line(name: str, amount: Column, pct: Column, weighted: Column, total: bool = False) -> Column:
        return F.struct(
            F.lit(name).alias("category"), amount.alias("amount"), pct.alias("confidence_pct"), weighted.alias("weighted_amount"), F.lit(total).alias("_total")
        )

    lines = [line("Closed Won", F.col("won"), F.lit(100.0), F.col("won"))]
    for i, name in enumerate(CLOSE_RATES):
        amount, weighted = F.col(f"a{i}"), F.col(f"w{i}")
        lines.append(line(name, amount, F.round(ratio(weighted, amount, digits=2, empty=0) * 100, 0), weighted))
    amount = F.round(sum((F.col(f"a{i}") for i in range(3)), F.col("won")), 2)
    weighted = F.round(sum((F.col(f"w{i}") for i in range(3)), F.col("won")), 4)
    lines.append(line("TOTAL FORECAST", amount, ratio(weighted, amount, 100, 0, empty=0), weighted, True))
    share = F.when(F.col("_total"), F.round(F.col("weighted_amount") / QUARTER_TARGET * 100, 1))
    return (
        one.select(F.inline(F.array(*lines)))
        .withColumns(
            {
                "quarter_target": F.lit(QUARTER_TARGET),
                "pct_of_target": share,
                "gap_to_target": F.when(F.col("_total"), F.lit(QUARTER_TARGET) - F.col("weighted_amount")),
                "risk_assessment": F.when(F.col("_total"), at_least(share, ((100, "ON TRACK"), (95, "ACHIEVABLE"), (85, "AT RISK")), "CRITICAL")),
            }
        )
        .drop("_total")
    )


@job
def swing_deals(deal_health: DataFrame, *, as_of) -> DataFrame:
    commit, health = F.col("forecast_category") == "Commit", F.col("health_score")
    chance = at_least(health, ((80, 0.85), (70, 0.70), (60, 0.55), (50, 0.40)), 0.25)
    return deal_health.filter(
        in_quarter(as_of, "close_date") & ~F.col("is_closed") & ((F.col("amount") >= 300000) | (commit & (health < 70)) | F.col("is_hero_deal"))
    ).select(
        "opportunity_id", "account_name", "opportunity_name", "amount", "owner_name", "stage_name", "forecast_category", "health_score",
        cases(
            [
                (commit & (health < 60), "MUST WIN - At Risk"),
                (commit & (health < 80), "MUST WIN - Monitor"),
                (commit, "MUST WIN - Healthy"),
                ((F.col("forecast_category") == "Best Case") & (health >= 70), "UPSIDE - Good Chance"),
            ],
            "UPSIDE - Needs Work",
        ).alias("swing_category"),
        chance.alias("win_probability"),
        F.round(F.col("amount") * chance, 0).alias("expected_value"),
        "days_in_current_stage", "stakeholder_count", "has_champion",
    )


@job
def forecast_rollup(opportunity_health_scored: DataFrame, *, as_of) -> DataFrame:
    """Current-quarter forecast at company, region and manager level from one scan."""
    stage, category, health = F.col("stage_name"), F.col("forecast_category"), F.col("health_category")
    worth = cases([(health == h, w) for h, w in HEALTH_WORTH.items()] + [(stage == "Closed Won", 1.0)], 0.5)
    adjusted = F.col("amount") * worth
    levels = [[], ["region"], ["manager_id", "manager_name", "region"]]
    return (
        opportunity_health_scored.filter(in_quarter(as_of, "close_date"))
        .groupingSets(levels, "region", "manager_id", "manager_name")
        .agg(
            by_value(F.grouping_id(), {7: "company", 3: "region"}, "manager").alias("level"),
            exact_sum("amount", where=stage == "Closed Won").alias("closed_won"),
            *[exact_sum("amount", where=category == n).alias(f"{a}_raw") for a, n in (("commit", "Commit"), ("best_case", "Best Case"), ("pipeline", "Pipeline"))],
            exact_sum(adjusted, 4, category == "Commit").alias("commit_adjusted"),
            exact_sum(adjusted, 4, category == "Best Case").alias("best_case_adjusted"),
            tally(category == "Commit").alias("commit_count"),
            tally(category == "Best Case").alias("best_case_count"),
            tally(stage == "Closed Won").alias("closed_won_count"),
            F.count("*").alias("total_deals"),
            F.count_distinct("owner_id").alias("rep_count"),
            F.avg(F.when(stage != "Closed Won", F.col("health_score"))).alias("avg_open_deal_health"),
            exact_sum("amount", where=category.isin("Commit", "Best Case") & health.isin("At Risk", "Critical")).alias("at_risk_in_forecast"),
        )
        .withColumns(
            {
                "total_forecast": F.col("closed_won") + F.col("commit_raw") + F.col("best_case_raw"),
                "adjusted_forecast": F.col("closed_won") + F.col("commit_adjusted") + F.col("best_case_adjusted") * 0.5,
            }
        )
        .withColumn("forecast_confidence", ratio("adjusted_forecast", "total_forecast", empty=1))
    )


@job
def company_forecast(forecast_rollup: DataFrame, *, as_of) -> DataFrame:
    return forecast_rollup.filter("level = 'company'").select(
        "closed_won", "commit_raw", "best_case_raw", "pipeline_raw", "commit_adjusted", "best_case_adjusted", "commit_count",
        "best_case_count", "closed_won_count", "avg_open_deal_health", "at_risk_in_forecast", "total_forecast", "adjusted_forecast",
        "forecast_confidence",
        ratio("closed_won", "total_forecast", empty=0).alias("closed_pct"),
        (F.col("commit_raw") + F.col("best_case_raw")).alias("remaining_to_close"),
        quarter_label(F.lit(as_of)).alias("quarter"),
    )


@job
def region_forecast(forecast_rollup: DataFrame) -> DataFrame:
    return forecast_rollup.filter("level = 'region'").select(
        "region", "closed_won", "commit_raw", "best_case_raw", "commit_adjusted", "best_case_adjusted", "commit_count",
        "avg_open_deal_health", "total_forecast", "adjusted_forecast", "forecast_confidence",
    )


@job
def manager_forecast(forecast_rollup: DataFrame) -> DataFrame:
    return forecast_rollup.filter("level = 'manager'").select(
        "manager_id", "manager_name", "region", "closed_won", "commit_raw", "best_case_raw", "commit_adjusted", "total_deals",
        "rep_count", F.col("avg_open_deal_health").alias("avg_team_health"), "total_forecast",
    )


def _health_weighted() -> Column:
    return F.col("amount") * (F.col("win_probability") / 100) * (F.col("health_score") / 100)


def _quota_total(quotas: DataFrame) -> Column:
    return quotas.agg(exact_sum("quota_amount")).scalar()


@job
def forecast_methods(deal_health: DataFrame, quotas: DataFrame, *, as_of) -> DataFrame:
    category = F.col("forecast_category")
    totals = deal_health.filter(~F.col("is_closed")).agg(
        exact_sum("amount", where=category == "Commit").alias("bottom_up_commit"),
        exact_sum("amount", where=category.isin("Commit", "Best Case")).alias("bottom_up_best_case"),
        exact_sum("amount").alias("total_pipeline"),
        exact_sum(_health_weighted(), 6).alias("ai_weighted_forecast"),
        exact_sum(F.col("amount") * (F.col("win_probability") / 100), 4).alias("probability_weighted"),
        exact_sum("amount", where=(F.col("win_probability") >= 70) & (F.col("health_score") >= 60)).alias("high_confidence_amount"),
        F.count("*").alias("total_deals"),
        tally(category == "Commit").alias("commit_deals"),
        F.avg("win_probability").alias("avg_win_probability"),
        F.avg("health_score").alias("avg_health_score"),
    )
    ai = F.col("ai_weighted_forecast")
    return totals.withColumn("quota", _quota_total(quotas)).withColumns(
        {
            "bottom_up_coverage": F.round(F.try_divide("bottom_up_commit", "quota"), 2),
            "ai_coverage": F.round(F.try_divide("ai_weighted_forecast", "quota"), 2),
            "pipeline_coverage": F.round(F.try_divide("total_pipeline", "quota"), 2),
            "forecast_spread": F.round(F.col("bottom_up_best_case") - ai, 6),
            "methodology_variance_pct": F.round(F.try_divide(F.col("bottom_up_commit") - ai, ai) * 100, 1),
            "snapshot_date": F.lit(as_of),
        }
    )


@job
def forecast_by_segment(deal_health: DataFrame) -> DataFrame:
    """The same block by segment, rep and stage via grouping sets."""
    dims = {"segment": 3, "owner_name": 5, "stage_name": 6}
    return (
        deal_health.filter(~F.col("is_closed"))
        .groupingSets([[d] for d in dims], *dims)
        .agg(
            F.grouping_id().alias("_gid"),
            exact_sum("amount").alias("pipeline_amount"),
            exact_sum("amount", where=F.col("forecast_category") == "Commit").alias("commit_amount"),
            exact_sum(_health_weighted(), 6).alias("weighted_forecast"),
            F.count("*").alias("deal_count"),
            F.avg("health_score").alias("avg_health"),
            F.avg("win_probability").alias("avg_win_prob"),
        )
        .select(
            by_value("_gid", {3: "segment", 5: "rep"}, "stage").alias("dimension"),
            F.coalesce(*dims).alias("dimension_value"),
            "pipeline_amount", "commit_amount", "weighted_forecast", "deal_count", "avg_health", "avg_win_prob",
            F.round(F.try_divide("commit_amount", "pipeline_amount") * 100, 1).alias("commit_rate"),
            F.round((F.col("avg_health") + F.col("avg_win_prob")) / 2, 0).alias("confidence_score"),
        )
    )


@job
def forecast_history(deal_health: DataFrame, *, as_of) -> DataFrame:
    """Twelve weekly positions rebuilt from creation and close dates.

    Each deal adds its amounts in the week it was created and takes them out in
    the week it closed; a running total over the twelve week rows gives the
    position, so no deal is repeated per week.
    """
    week_of = lambda d: F.greatest(F.lit(1), HISTORY_WEEKS - F.floor(age_days(as_of, d) / 7)).cast("int")
    amount = F.col("amount")
    commit = F.when(F.col("forecast_category") == "Commit", amount).otherwise(F.lit(0.0))
    weighted = amount * (F.col("win_probability") / 100)
    change = lambda when, wk, sign, won: F.when(
        when,
        F.struct(wk.alias("week_number"), (amount * sign).alias("p"), (commit * sign).alias("c"), (weighted * sign).alias("w"), won.alias("won")),
    )
    today = F.lit(as_of)
    moves = deal_health.select(
        F.inline(
            F.array_compact(
                F.array(
                    change(F.col("created_date") <= today, week_of("created_date"), 1, F.lit(0.0)),
                    change(
                        F.col("is_closed") & (F.col("close_date") <= today) & (F.col("created_date") <= today),
                        week_of("close_date"), -1, F.when(F.col("is_won"), amount).otherwise(F.lit(0.0)),
                    ),
                )
            )
        )
    )
    per_week = moves.groupBy("week_number").agg(*[exact_sum(n, 4).alias(n) for n in ("p", "c", "w", "won")])
    weeks = deal_health.sparkSession.range(1, HISTORY_WEEKS + 1).select(F.col("id").cast("int").alias("week_number"))
    running = Window.orderBy("week_number")
    total = lambda n: F.round(F.sum(nvl(n, 0.0)).over(running), 4)
    return weeks.join(per_week, "week_number", "left").select(
        "week_number",
        F.concat(F.lit("W"), F.col("week_number").cast("string")).alias("week_label"),
        F.date_sub(today, (HISTORY_WEEKS - F.col("week_number")) * 7).alias("snapshot_date"),
        total("p").alias("pipeline_amount"),
        total("c").alias("commit_amount"),
        total("w").alias("ai_forecast"),
        total("won").alias("closed_won"),
        F.lit(HISTORY_TARGET).alias("target"),
    ).withColumns(
        {
            "gap_to_target": F.round(F.col("target") - F.col("closed_won") - F.col("ai_forecast"), 4),
            "forecast_accuracy": F.round(F.col("ai_forecast") / F.col("target") * 100, 1),
        }
    )


@job
def forecast_accuracy(deal_health: DataFrame, *, as_of) -> DataFrame:
    """Accuracy of three methods over the three quarters before ``as_of``'s quarter.

    For the deals closed in a quarter: commit = amount of deals scored 60 or
    better, weighted = amount x health, historical = closed amount x the win rate
    (by value) of everything closed earlier; each against the amount won.
    """
    bounds = [quarter_bounds(as_of)]
    for _ in range(3):
        first = bounds[0][0]
        month = first.month - 3 if first.month > 3 else first.month + 9
        bounds.insert(0, quarter_bounds(first.replace(year=first.year - (first.month <= 3), month=month)))
    sums = []
    for i, (lo, hi) in enumerate(bounds[:3]):
        inside, before = F.col("close_date").between(F.lit(lo), F.lit(hi)), F.col("close_date") < F.lit(lo)
        sums += [
            exact_sum("amount", where=inside & F.col("is_won")).alias(f"won{i}"),
            exact_sum("amount", where=inside).alias(f"all{i}"),
            exact_sum("amount", where=inside & (F.col("health_score") >= 60)).alias(f"fc0_{i}"),
            exact_sum(F.col("amount") * (F.col("health_score") / 100), 4, inside).alias(f"fc1_{i}"),
            (F.try_divide(exact_sum("amount", where=before & F.col("is_won")), exact_sum("amount", where=before))).alias(f"rate{i}"),
        ]
    one = deal_health.filter("is_closed").agg(*sums)
    one = one.withColumns({f"fc2_{i}": F.col(f"all{i}") * F.col(f"rate{i}") for i in range(3)})

    def line(m: int, name: str) -> Column:
        hit = [F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(F.col(f"fc{m}_{i}") - F.col(f"won{i}")), F.col(f"fc{m}_{i}"))) for i in range(3)]
        lean = sum((F.col(f"fc{m}_{i}") - F.col(f"won{i}") for i in range(1, 3)), F.col(f"fc{m}_0") - F.col("won0"))
        return F.struct(
            F.lit(name).alias("method"),
            *[F.round(h, 4).alias(f"q{i + 1}_accuracy") for i, h in enumerate(hit)],
            F.round((hit[0] + hit[1] + hit[2]) / 3, 4).alias("avg_accuracy"),
            cases([(lean > 0, "optimistic"), (lean < 0, "pessimistic")], "neutral").alias("bias"),
        )

    rows = one.select(F.inline(F.array(line(0, "Bottom-Up Commit"), line(1, "AI-Weighted"), line(2, "Historical Rate"))))
    return rows.withColumns(
        {
            "accuracy_tier": at_least("avg_accuracy", ((0.90, "High"), (0.80, "Medium")), "Low"),
            "recommended": nvl(F.col("avg_accuracy") >= 0.90, False),
        }
    )


@job
def forecast_summary(forecast_methods: DataFrame, forecast_by_segment: DataFrame, forecast_history: DataFrame, forecast_accuracy: DataFrame) -> DataFrame:
    best = forecast_accuracy.agg(F.max_by(F.struct("method", "avg_accuracy"), F.struct("avg_accuracy", "method")).alias("m"))
    latest = forecast_history.agg(F.max_by(F.struct("gap_to_target", "closed_won"), "week_number").alias("h"))
    top = forecast_by_segment.filter("dimension = 'segment'").agg(
        F.max_by(F.struct("dimension_value", "weighted_forecast"), F.struct("weighted_forecast", "dimension_value")).alias("s")
    )
    return side_by_side(forecast_methods, best, latest, top).select(
        "quota", "total_pipeline", "pipeline_coverage",
        F.col("bottom_up_commit").alias("bottom_up_forecast"),
        F.col("ai_weighted_forecast").alias("ai_forecast"),
        F.col("bottom_up_best_case").alias("best_case_forecast"),
        "high_confidence_amount", "methodology_variance_pct",
        F.col("m.method").alias("recommended_method"),
        F.col("m.avg_accuracy").alias("method_accuracy"),
        "h.gap_to_target",
        F.col("h.closed_won").alias("closed_won_ytd"),
        nvl("s.dimension_value", "N/A").alias("top_segment"),
        nvl("s.weighted_forecast", 0.0).alias("top_segment_forecast"),
        at_least("ai_coverage", ((0.9, "High"), (0.7, "Medium")), "Low").alias("forecast_confidence"),
        F.lit(4).alias("weeks_remaining"),
        ((F.col("quota") - F.col("h.closed_won")) / 4).alias("required_weekly_close"),
        "snapshot_date",
    )


@job
def win_probability_scores(deal_health: DataFrame, activities: DataFrame, stage_benchmarks: DataFrame, rep_performance: DataFrame, *, as_of) -> DataFrame:
    """Eight weighted factors under a stage ceiling."""
    touched = activities.groupBy("opportunity_id").agg(F.count("*").alias("touches"), F.max("activity_date").alias("last_touch"))
    record = rep_performance.select(F.col("rep_id").alias("owner_id"), F.col("win_rate").alias("rep_win_rate"))
    bench = stage_benchmarks.select("stage_name", F.col("expected_days").alias("norm"))
    quiet, spent, norm, off = age_days(as_of, "last_touch"), F.col("days_in_current_stage"), nvl("norm", 14), nvl("discount_percent", 0.0)
    factors = {
        "health_factor": (F.col("health_score"), 0.25),
        "activity_recency_factor": (at_most(quiet, ((3, 100), (7, 80), (14, 50), (21, 30)), 10), 0.20),
        "activity_volume_factor": (F.least(nvl("touches", 0) * 10, F.lit(100)), 0.10),
        "stakeholder_factor": (at_least("stakeholder_count", ((5, 100), (4, 90), (3, 75), (2, 50)), 20), 0.15),
        "velocity_factor": (cases(((spent <= norm * m, p) for m, p in ((1.0, 100), (1.5, 70), (2.0, 40))), 15), 0.10),
        "rep_factor": (nvl("rep_win_rate", 0.25) * 100 * 2, 0.10),
        "competitive_factor": (F.when(F.col("is_competitive"), 60).otherwise(100), 0.05),
        "discount_factor": (over(off, ((30, 40), (20, 60), (10, 80)), 100), 0.05),
    }
    weights = [(n, w) for n, (_, w) in factors.items()]
    raw = sum((F.col(n) * w for n, w in weights[1:]), F.col(weights[0][0]) * weights[0][1])
    scored = (
        deal_health.filter(~F.col("is_closed"))
        .drop("days_since_activity", "win_probability")
        .join(touched, "opportunity_id", "left")
        .join(record, "owner_id", "left")
        .join(bench, "stage_name", "left")
        .withColumns({n: e for n, (e, _) in factors.items()})
        .withColumn("p", F.least(raw, by_value("stage_name", STAGE_CEILING, 50.0)))
    )
    return scored.select(
        "opportunity_id", "opportunity_name", "account_name", "owner_id", "owner_name", "amount", "stage_name", "close_date", "health_score",
        F.round("p", 1).alias("win_probability"),
        at_least("p", ((75, "High"), (50, "Medium"), (25, "Low")), "Very Low").alias("win_probability_tier"),
        cases(
            [
                (F.col("touches").isNotNull() & F.col("stakeholder_count").isNotNull() & F.col("rep_win_rate").isNotNull(), "High"),
                (F.col("touches").isNotNull() | F.col("stakeholder_count").isNotNull(), "Medium"),
            ],
            "Low",
        ).alias("prediction_confidence"),
        "health_factor", "activity_recency_factor", "stakeholder_factor", "velocity_factor",
        F.round("rep_factor", 1).alias("rep_factor"),
        "competitive_factor",
        nvl(quiet, 0).alias("days_since_activity"),
        nvl("stakeholder_count", 1).alias("stakeholder_count"),
        nvl("touches", 0).alias("total_activities"),
        F.round(F.col("amount") * F.col("p") / 100, 0).alias("weighted_amount"),
        F.lit(as_of).alias("scored_date"),
    )


@job
def slip_risk_scores(win_probability_scores: DataFrame, *, as_of) -> DataFrame:
    left, stage = F.col("days_until_close"), F.col("stage_name")
    risks = {
        "time_pressure_factor": under(left, ((0, 95), (7, 70), (14, 50), (30, 30)), 15),
        "stage_alignment_factor": cases(
            [
                ((left < 30) & stage.isin("Prospecting", "Discovery", "Solution Design"), 85),
                ((left < 14) & (stage == "Proposal"), 60),
                ((left < 7) & (stage != "Verbal Commit"), 75),
            ],
            20,
        ),
        "momentum_factor": over("days_since_activity", ((14, 80), (7, 50), (3, 25)), 10),
        "_doubt": 100 - F.col("win_probability"),
    }
    score = F.col("time_pressure_factor") * 0.30 + F.col("stage_alignment_factor") * 0.30 + F.col("momentum_factor") * 0.20 + F.col("_doubt") * 0.20
    tier = F.col("slip_risk_tier")
    return (
        win_probability_scores.withColumn("days_until_close", days_ahead(as_of, "close_date"))
        .withColumns(risks)
        .withColumn("_score", score)
        .withColumn("slip_risk_tier", at_least("_score", ((70, "High"), (45, "Medium")), "Low"))
        .select(
            "opportunity_id", "opportunity_name", "account_name", "owner_id", "owner_name", "amount", "stage_name", "close_date",
            "days_until_close", "win_probability", F.round("_score", 1).alias("slip_risk_score"), "slip_risk_tier",
            cases(
                [
                    (left < 0, "Close date already passed"),
                    (F.col("stage_alignment_factor") >= 60, F.format_string("Still in %s with only %d days left", stage, left)),
                    (F.col("momentum_factor") >= 50, F.format_string("No activity in %d days", F.col("days_since_activity"))),
                    (F.col("_doubt") >= 50, "Low win probability"),
                ],
                "On track",
            ).alias("slip_risk_reason"),
            "time_pressure_factor", "stage_alignment_factor", "momentum_factor",
            cases([(tier == "High", F.col("amount")), (tier == "Medium", F.col("amount") * 0.5)], 0.0).alias("slip_risk_amount"),
            F.lit(as_of).alias("scored_date"),
        )
    )


@job
def leading_indicators_summary(win_probability_scores: DataFrame, slip_risk_scores: DataFrame, *, as_of) -> DataFrame:
    win_tier, slip_tier = F.col("win_probability_tier"), F.col("slip_risk_tier")
    win = win_probability_scores.agg(
        F.count("*").alias("total_opportunities"),
        exact_sum("amount").alias("total_pipeline"),
        exact_sum("weighted_amount").alias("probability_weighted_pipeline"),
        F.round(exact_avg("win_probability", 1), 1).alias("avg_win_probability"),
        *[
            e
            for t in ("High", "Medium", "Low")
            for e in (tally(win_tier == t).alias(f"{t.lower()}_prob_count"), exact_sum("amount", where=win_tier == t).alias(f"{t.lower()}_prob_amount"))
        ],
        F.round(F.avg("activity_recency_factor"), 1).alias("avg_activity_recency"),
        F.round(F.avg("stakeholder_factor"), 1).alias("avg_stakeholder_engagement"),
        F.round(F.avg("velocity_factor"), 1).alias("avg_velocity_score"),
    )
    slip = slip_risk_scores.agg(
        *[
            e
            for t in ("High", "Medium")
            for e in (tally(slip_tier == t).alias(f"{t.lower()}_slip_risk_count"), exact_sum("amount", where=slip_tier == t).alias(f"{t.lower()}_slip_risk_amount"))
        ],
        exact_sum("slip_risk_amount", 3).alias("total_slip_risk_amount"),
        F.round(exact_avg("slip_risk_score", 1), 1).alias("avg_slip_risk"),
    )
    return side_by_side(win, slip).withColumns(
        {
            "ai_forecast_adjustment": F.round(F.col("probability_weighted_pipeline") - F.col("total_slip_risk_amount"), 3),
            "forecast_confidence": cases(
                [
                    ((F.col("avg_win_probability") >= 60) & (F.col("avg_slip_risk") < 40), "High"),
                    ((F.col("avg_win_probability") >= 45) & (F.col("avg_slip_risk") < 55), "Medium"),
                ],
                "Low",
            ),
            "primary_risk_factor": cases(
                [
                    (F.col("avg_activity_recency") < 50, "Activity engagement declining"),
                    (F.col("avg_stakeholder_engagement") < 50, "Insufficient stakeholder coverage"),
                    (F.col("avg_velocity_score") < 50, "Deals progressing slowly"),
                    (F.col("avg_slip_risk") >= 50, "High slip risk concentration"),
                ],
                "No major concerns",
            ),
            "scored_date": F.lit(as_of),
        }
    )


@job
def deal_predictions(win_probability_scores: DataFrame, slip_risk_scores: DataFrame) -> DataFrame:
    slip = slip_risk_scores.select("opportunity_id", "slip_risk_score", "slip_risk_tier", "slip_risk_reason", "slip_risk_amount")
    p, risk = F.col("win_probability"), F.col("slip_risk_score")
    return win_probability_scores.join(slip, "opportunity_id", "left").select(
        "opportunity_id", "opportunity_name", "account_name", "owner_id", "owner_name", "amount", "stage_name", "close_date", "health_score",
        "win_probability", "win_probability_tier",
        nvl(risk, 0.0).alias("slip_risk_score"),
        nvl("slip_risk_tier", "Low").alias("slip_risk_tier"),
        cases(
            [
                ((p >= 70) & (risk < 40), "Strong likelihood to close this quarter"),
                ((p >= 50) & (risk < 50), "Good probability with manageable risk"),
                ((p >= 50) & (risk >= 50), "Good potential but slip risk is elevated"),
                ((p < 50) & (risk >= 60), "At risk - needs intervention to stay on track"),
            ],
            "Uncertain - requires close monitoring",
        ).alias("prediction_summary"),
        cases(
            [
                (F.col("activity_recency_factor") < 50, "Re-engage - activity has dropped off"),
                (F.col("stakeholder_factor") < 50, "Multi-thread - need more stakeholders"),
                (F.col("velocity_factor") < 50, "Accelerate - deal is stalling"),
                (risk >= 60, "Close date at risk - validate timeline"),
            ],
            "Continue current approach",
        ).alias("recommended_focus"),
        at_least(p, ((70, "WIN"), (40, "TOSS-UP")), "UNLIKELY").alias("expected_outcome"),
        "weighted_amount",
        nvl("slip_risk_amount", 0.0).alias("slip_risk_amount"),
        "health_factor", "activity_recency_factor", "stakeholder_factor", "velocity_factor", "prediction_confidence", "scored_date",
    )


def _open_totals(deal_health: DataFrame) -> DataFrame:
    return deal_health.filter(~F.col("is_closed")).agg(
        F.count("*").alias("deal_count"),
        exact_sum("amount").alias("pipeline"),
        exact_avg("amount").alias("deal_size"),
        (F.avg("win_probability") / 100).alias("win_rate"),
        F.avg("days_in_current_stage").alias("days"),
    )


def _clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _levers(base: DataFrame, name: str, deltas: list[tuple[str, float]], kind: str) -> DataFrame:
    """Repeat the one-row base for each named change of a lever."""
    grid = F.array(*[F.struct(F.lit(label).alias("scenario_name"), F.lit(d).cast(kind).alias(name)) for label, d in deltas])
    return base.select("*", F.inline(grid))


@job
def scenario_base_metrics(deal_health: DataFrame, quotas: DataFrame) -> DataFrame:
    base = deal_health.filter(~F.col("is_closed")).agg(
        F.count("*").alias("total_deals"),
        exact_sum("amount").alias("total_pipeline"),
        exact_avg("amount").alias("avg_deal_size"),
        F.avg("health_score").alias("avg_health_score"),
        F.avg("win_probability").alias("avg_win_probability"),
        exact_sum(F.col("amount") * F.col("win_probability") / 100, 4).alias("weighted_pipeline"),
    )
    return base.withColumn("total_quota", _quota_total(quotas)).withColumns(
        {
            "coverage_ratio": F.round(F.try_divide("total_pipeline", "total_quota"), 2),
            "weighted_coverage": F.round(F.try_divide("weighted_pipeline", "total_quota"), 2),
        }
    )


@job
def scenario_win_rate_impact(deal_health: DataFrame) -> DataFrame:
    deltas = [(f"{d:+d}% Win Rate" if d else "Baseline", d / 100) for d in (-10, -5, 0, 5, 10)]
    d, rate, pool = F.col("win_rate_delta"), F.col("win_rate"), F.col("pipeline")
    new = _clamped(rate + d)
    return _levers(_open_totals(deal_health), "win_rate_delta", deltas, "double").select(
        "scenario_name", "win_rate_delta",
        new.alias("projected_win_rate"),
        (pool * new).alias("projected_revenue"),
        (pool * new - pool * rate).alias("revenue_delta"),
        ratio(d, rate, empty=0).alias("revenue_delta_pct"),
    )


@job
def scenario_deal_size_impact(deal_health: DataFrame) -> DataFrame:
    deltas = [(f"{d:+d}% Avg Deal Size" if d else "Baseline", d / 100) for d in (-15, -10, -5, 0, 5, 10, 15)]
    size, n, rate = F.col("deal_size") * (1 + F.col("deal_size_delta_pct")), F.col("deal_count"), F.col("win_rate")
    return _levers(_open_totals(deal_health), "deal_size_delta_pct", deltas, "double").select(
        "scenario_name", "deal_size_delta_pct",
        size.alias("projected_deal_size"),
        (size * n).alias("projected_pipeline"),
        (size * n * rate).alias("projected_revenue"),
        (size * n * rate - F.col("deal_size") * n * rate).alias("revenue_delta"),
    )


@job
def scenario_cycle_time_impact(deal_health: DataFrame) -> DataFrame:
    """A week saved is worth one point of win rate and 5 % more deals per quarter."""
    label = lambda d: "Baseline" if d == 0 else f"{-d}d faster" if d < 0 else f"{d}d slower"
    deltas = [(label(d), d) for d in (14, 7, 0, -7, -14)]
    weeks = -F.col("cycle_days_delta") / 7
    rate, pool = F.col("win_rate"), F.col("pipeline")
    new = _clamped(rate + weeks * 0.01)
    return _levers(_open_totals(deal_health), "cycle_days_delta", deltas, "int").select(
        "scenario_name", "cycle_days_delta",
        (F.col("days") + F.col("cycle_days_delta")).alias("projected_cycle_days"),
        (weeks * 0.01).alias("win_rate_impact"),
        new.alias("projected_win_rate"),
        (pool * new).alias("projected_revenue"),
        (pool * new - pool * rate).alias("revenue_delta"),
        (weeks * 0.05).alias("deals_per_quarter_change"),
    )


@job
def scenario_summary(scenario_win_rate_impact: DataFrame, scenario_deal_size_impact: DataFrame, scenario_cycle_time_impact: DataFrame, *, as_of) -> DataFrame:
    best = lambda df, tag: df.agg(
        F.max_by(F.struct("scenario_name", "revenue_delta"), F.struct("projected_revenue", "scenario_name")).alias(tag)
    )
    at_base = F.col("scenario_name") == "Baseline"
    win0 = scenario_win_rate_impact.agg(
        F.max(F.when(at_base, F.col("projected_revenue"))).alias("baseline_revenue"),
        F.max(F.when(at_base, F.col("projected_win_rate"))).alias("baseline_win_rate"),
    )
    size0 = scenario_deal_size_impact.agg(
        F.max(F.when(at_base, F.col("projected_deal_size"))).alias("baseline_deal_size"),
        F.max(F.when(at_base, F.col("projected_revenue"))).alias("_size_revenue"),
    )
    one = side_by_side(win0, size0, best(scenario_win_rate_impact, "w"), best(scenario_deal_size_impact, "s"), best(scenario_cycle_time_impact, "t"))
    return one.select(
        "baseline_revenue", "baseline_win_rate", "baseline_deal_size",
        F.col("w.scenario_name").alias("win_rate_best_scenario"),
        F.col("w.revenue_delta").alias("win_rate_upside"),
        ratio("w.revenue_delta", "baseline_revenue", empty=0).alias("win_rate_upside_pct"),
        F.col("s.scenario_name").alias("deal_size_best_scenario"),
        F.col("s.revenue_delta").alias("deal_size_upside"),
        ratio("s.revenue_delta", "_size_revenue", empty=0).alias("deal_size_upside_pct"),
        F.col("t.scenario_name").alias("cycle_time_best_scenario"),
        F.col("t.revenue_delta").alias("cycle_time_upside"),
        (F.col("w.revenue_delta") + F.col("s.revenue_delta") + F.col("t.revenue_delta")).alias("total_upside_potential"),
        F.lit(as_of).alias("snapshot_date"),
    )

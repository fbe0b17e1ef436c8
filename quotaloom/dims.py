"""Fixed dimensions: values that must be equal for equal results."""

# Stage, expected days, maximum acceptable days, conversion, order.
STAGE_BENCHMARKS = (
    ("Prospecting", 7, 14, 0.80, 1),
    ("Discovery", 14, 21, 0.70, 2),
    ("Solution Design", 21, 35, 0.65, 3),
    ("Proposal", 10, 18, 0.60, 4),
    ("Negotiation", 14, 28, 0.75, 5),
    ("Verbal Commit", 5, 10, 0.90, 6),
    ("Legal Review", 5, 10, 0.95, 7),
    ("Security Review", 3, 7, 0.98, 8),
    ("Procurement", 7, 14, 0.95, 9),
)

# Stage order of the funnel and win-probability percent by stage.
FUNNEL = {
    "Prospecting": 1,
    "Discovery": 2,
    "Solution Design": 3,
    "Proposal": 4,
    "Negotiation": 5,
    "Verbal Commit": 6,
}
CONVERSION_BY_STAGE = {
    "Prospecting": 0.65,
    "Discovery": 0.70,
    "Solution Design": 0.75,
    "Proposal": 0.60,
    "Negotiation": 0.80,
    "Verbal Commit": 0.95,
}

# Health bands and what each is worth in a forecast.
HEALTH_BANDS = ((80, "Healthy"), (60, "Monitor"), (40, "At Risk"))
HEALTH_WORTH = {"Healthy": 1.0, "Monitor": 0.85, "At Risk": 0.60, "Critical": 0.30}
HEALTH_WEIGHTS = {
    "velocity_score": 0.25,
    "activity_score": 0.25,
    "stakeholder_score": 0.25,
    "competition_score": 0.15,
    "discount_score": 0.10,
}

# Hygiene alerts in order of priority: flag, code, severity, action.
HYGIENE_ALERTS = (
    ("is_gone_dark", "GONE_DARK", "CRITICAL", "Immediate outreach required - contact has gone dark for 14+ days"),
    ("is_stale_close_date", "STALE_CLOSE_DATE", "CRITICAL", "Update close date - current date has passed"),
    ("is_overdue_commit", "OVERDUE_COMMIT", "CRITICAL", "Risk to commit - health score low with close date approaching"),
    ("is_missing_champion", "MISSING_CHAMPION", "HIGH", "Identify and cultivate internal champion"),
    ("is_single_threaded", "SINGLE_THREADED", "HIGH", "Multi-thread: engage additional stakeholders"),
    ("is_stalled_stage", "STALLED_STAGE", "MEDIUM", "Deal stalled - review blockers and re-engage"),
    ("is_missing_next_steps", "MISSING_NEXT_STEPS", "MEDIUM", "Schedule follow-up activity within 7 days"),
    ("is_heavy_discount", "HEAVY_DISCOUNT", "LOW", "Review discount approval - exceeds 20% threshold"),
)
SEVERITY_RANK = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3}
SEVERITY_ICON = {"CRITICAL": "rotating_light:", "HIGH": "warning:", "MEDIUM": "large_yellow_circle:"}

# Texts of the process analysis by activity.
BOTTLENECK_CAUSE = {
    "Legal Review": "Legal team capacity insufficient; complex custom terms increasing review time",
    "Security Review": "Enterprise security requirements creating backlog; limited security resources",
    "Procurement": "Customer procurement processes vary; limited visibility into requirements",
    "Solution Design": "Technical complexity; may need more SE resources or clearer scoping",
    "Negotiation": "Pricing authority unclear; multiple rounds of approvals required",
}
BOTTLENECK_ACTION = {
    "Legal Review": "1) Create standard terms template (80% of cases). 2) Add legal headcount or contractor. 3) Implement 5-day SLA with escalation.",
    "Security Review": "1) Pre-populate security questionnaires. 2) Create security package for common questions. 3) Dedicated enterprise security resource.",
    "Procurement": "1) Earlier procurement engagement. 2) Standard procurement guide for customers. 3) Multi-thread to procurement early.",
    "Solution Design": "1) Improve scoping in Discovery. 2) SE capacity planning. 3) Templatized solution designs for common use cases.",
    "Negotiation": "1) Clear pricing authority matrix. 2) Pre-approved discount tiers. 3) Executive sponsor engagement earlier.",
}
REWORK_CAUSE = {
    "Proposal": "Insufficient discovery - requirements changed after proposal",
    "Discovery": "New stakeholders introduced - rediscovery required",
    "Solution Design": "Technical requirements evolved - redesign needed",
}

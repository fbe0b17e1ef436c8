"""All job modules, imported so that their jobs are registered."""

from __future__ import annotations

import importlib

MODULES = (
    "sources.warehouse",
    "sources.crm_raw",
    "operators.ingest",
    "operators.matching",
    "operators.enrichment",
    "operators.pipeline",
    "operators.sales",
    "operators.forecast",
    "operators.territory",
    "operators.customer",
    "operators.telemetry",
    "operators.models",
    "operators.loop",
    "sources.tenant_feeds",
    "operators.commercial",
    "operators.monitor",
    "sources.billing_feeds",
    "operators.billing",
    "plans.quality",
    "plans.sqlpack",
)

# Literal dimensions: inputs of jobs, not queries over the given tables.
DIMENSIONS = {"stage_benchmarks", "plan_limits", "price_book"}
# Raw feeds shaped from the given tables; the staging jobs over them are the queries.
FEED_PREFIXES = ("crm_a_", "crm_b_", "stored_")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"quotaloom.{name}")


load()

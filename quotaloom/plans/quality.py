"""Data-quality checks as columns: all checks of a table run in one aggregation.

Keys need one grouped pass and foreign keys one anti join; results are a
DataFrame, and ``enforce`` raises on failed checks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.functions.exprs import nvl, tally
from quotaloom.plans.registry import job


class QualityError(Exception):
    """At least one check failed."""


@dataclass(frozen=True)
class Check:
    """``observed`` is an aggregate; the check passes when ``passes(observed)`` holds."""

    name: str
    observed: Column
    passes: object


def row_count(least: int = 1, most: int | None = None) -> Check:
    return Check("row_count", F.count("*").cast("double"), lambda v: (v >= least) if most is None else v.between(least, most))


def no_nulls(col: str) -> Check:
    return Check(f"no_nulls_{col}", tally(F.col(col).isNull()).cast("double"), lambda v: v == 0)


def null_rate(col: str, most: float) -> Check:
    return Check(f"null_rate_{col}", nvl(F.try_divide(tally(F.col(col).isNull()), F.count("*")), 0.0), lambda v: v <= most)


def values_in(col: str, allowed: Iterable[str]) -> Check:
    return Check(f"values_in_{col}", tally(nvl(~F.col(col).isin(*allowed), False)).cast("double"), lambda v: v == 0)


def positive(col: str) -> Check:
    return Check(f"positive_{col}", tally(nvl(F.col(col) < 0, False)).cast("double"), lambda v: v == 0)


def in_range(col: str, low: float, high: float) -> Check:
    return Check(f"in_range_{col}", tally(nvl((F.col(col) < low) | (F.col(col) > high), False)).cast("double"), lambda v: v == 0)


def matches(col: str, pattern: str) -> Check:
    return Check(f"matches_{col}", tally(nvl(~F.col(col).rlike(pattern), False)).cast("double"), lambda v: v == 0)


def longest(col: str, most: int) -> Check:
    return Check(f"length_{col}", tally(nvl(F.length(col) > most, False)).cast("double"), lambda v: v == 0)


def fresh(col: str, as_of: dt.date, most_days: int) -> Check:
    return Check(f"freshness_{col}", F.datediff(F.lit(as_of), F.max(col)).cast("double"), lambda v: v <= most_days)


def implies(name: str, if_true: Column, then: Column) -> Check:
    """Rows that break ``if_true => then``."""
    return Check(name, tally(nvl(if_true, False) & ~nvl(then, False)).cast("double"), lambda v: v == 0)


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    one = df.agg(*[c.observed.alias(f"c{i}") for i, c in enumerate(checks)])
    rows = [
        F.struct(F.lit(c.name).alias("check"), F.col(f"c{i}").alias("observed"), nvl(c.passes(F.col(f"c{i}")), False).alias("passed")) for i, c in enumerate(checks)
    ]
    return one.select(F.inline(F.array(*rows)))


def result_row(df: DataFrame, name: str) -> DataFrame:
    """A one-column count as a check result that passes at zero."""
    n = F.col(df.columns[0]).cast("double")
    return df.select(F.lit(name).alias("check"), n.alias("observed"), (n == 0).alias("passed"))


def unique_key(df: DataFrame, *cols: str) -> DataFrame:
    repeated = df.groupBy(*cols).agg(F.count("*").alias("n")).agg(nvl(F.sum(F.col("n") - 1), 0))
    return result_row(repeated, f"unique_{'+'.join(cols)}")


def foreign_key(df: DataFrame, col: str, ref: DataFrame, ref_col: str) -> DataFrame:
    keys = ref.select(F.col(ref_col).alias(col))
    return result_row(df.filter(F.col(col).isNotNull()).join(keys, col, "left_anti").agg(F.count("*")), f"fk_{col}")


def columns_exist(df: DataFrame, *cols: str) -> list[str]:
    return [c for c in cols if c not in df.columns]


def invalid_sample(df: DataFrame, col: str, allowed: Iterable[str]) -> DataFrame:
    """Five smallest distinct values outside the allowed set."""
    return df.filter(~F.col(col).isin(*allowed)).select(col).distinct().orderBy(col).limit(5)


def split_rows(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows; an unknown predicate quarantines."""
    return df.filter(nvl(valid, False)), df.filter(~nvl(valid, False))


def enforce(results: DataFrame, table: str) -> DataFrame:
    failed = results.filter(~F.col("passed")).select("check", "observed").collect()
    if failed:
        raise QualityError(f"{table}: " + "; ".join(f"{r['check']} = {r['observed']:g}" for r in failed))
    return results


# Enumerations of the canonical entities.
STAGES = ("Prospecting", "Discovery", "Solution Design", "Proposal", "Negotiation", "Verbal Commit", "Closed Won", "Closed Lost")
CATEGORIES = ("Pipeline", "Best Case", "Commit", "Closed", "Omitted")
BANDS = ("Healthy", "Monitor", "At Risk", "Critical")


def opportunity_checks() -> list[Check]:
    return [row_count(), no_nulls("opportunity_id"), no_nulls("amount"), no_nulls("close_date"), positive("amount"), values_in("stage_name", STAGES), null_rate("owner_id", 0.05)]


def health_checks() -> list[Check]:
    return [row_count(), no_nulls("opportunity_id"), no_nulls("health_score"), no_nulls("health_category"), in_range("health_score", 0, 100), values_in("health_category", BANDS)]


def forecast_checks() -> list[Check]:
    return [row_count(), no_nulls("category"), no_nulls("weighted_amount"), positive("weighted_amount"), in_range("confidence_pct", 0, 100)]


@job
def quality_opportunities(opportunities: DataFrame, accounts: DataFrame, sales_reps: DataFrame, *, as_of) -> DataFrame:
    won, stage = F.col("is_won"), F.col("stage_name")
    checks = opportunity_checks() + [
        fresh("close_date", as_of, 30), implies("won_is_closed_won", won, stage == "Closed Won"),
        implies("closed_stage", F.col("is_closed"), stage.isin("Closed Won", "Closed Lost")), matches("opportunity_name", "^Deal [0-9]+$"), longest("opportunity_name", 255),
    ]
    parts = [run_checks(opportunities, checks), unique_key(opportunities, "opportunity_id"), foreign_key(opportunities, "account_id", accounts, "account_id"), foreign_key(opportunities, "owner_id", sales_reps, "rep_id")]
    return reduce(DataFrame.unionByName, parts)


@job
def quality_health(deal_health: DataFrame) -> DataFrame:
    return run_checks(deal_health, health_checks())


@job
def quality_forecast(forecast_confidence: DataFrame) -> DataFrame:
    return run_checks(forecast_confidence, forecast_checks())


@dataclass(frozen=True)
class FieldRule:
    """Declared contract of one field."""

    name: str
    dtype: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] | None = None
    longest: int | None = None
    pattern: str | None = None


# Contracts of the canonical entities.
CONTRACTS = {
    "opportunities": (
        FieldRule("opportunity_id", "bigint", True), FieldRule("opportunity_name", "string", True, longest=255, pattern="^Deal "), FieldRule("account_id", "bigint", True),
        FieldRule("owner_id", "bigint", True), FieldRule("amount", "double", True, 0, 100000000), FieldRule("stage_name", "string", True, allowed=STAGES),
        FieldRule("forecast_category", "string", False, allowed=CATEGORIES), FieldRule("win_probability", "double", False, 0, 100), FieldRule("close_date", "date", True),
        FieldRule("discount_percent", "double", False, 0, 25),
    ),
    "activities": (
        FieldRule("activity_id", "bigint", True), FieldRule("activity_type", "string", True, allowed=("Call", "Email", "Meeting", "Demo", "Task")),
        FieldRule("activity_date", "date", True), FieldRule("duration_minutes", "int", False, 0, 480), FieldRule("subject", "string", False, longest=255),
    ),
}


def check_contract(df: DataFrame, table: str, rules: tuple[FieldRule, ...]) -> DataFrame:
    """Every rule of a contract counted in one aggregation; type checks need no scan."""
    tests: list[tuple[FieldRule, str, Column]] = []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    for r in rules:
        if r.name not in kinds:
            tests.append((r, "missing", F.lit(1).cast("bigint")))
            continue
        col = F.col(r.name)
        tests.append((r, "type", F.lit(int(kinds[r.name] != r.dtype)).cast("bigint")))
        bad = {
            "required": col.isNull() if r.required else None,
            "range": (col < r.low) | (col > r.high) if r.low is not None else None,
            "allowed": ~col.isin(*r.allowed) if r.allowed else None,
            "length": F.length(col) > r.longest if r.longest else None,
            "pattern": ~col.rlike(r.pattern) if r.pattern else None,
        }
        tests += [(r, rule, tally(nvl(t, False))) for rule, t in bad.items() if t is not None]
    one = df.agg(F.count("*").alias("_rows"), *[t.alias(f"t{i}") for i, (_, _, t) in enumerate(tests)])
    rows = [
        F.struct(
            F.lit(table).alias("table"), F.lit(r.name).alias("field"), F.lit(rule).alias("rule"),
            F.lit("error" if rule in ("missing", "type", "required") else "warning").alias("level"), F.col(f"t{i}").alias("violations"),
        )
        for i, (r, rule, _) in enumerate(tests)
    ]
    return one.select(F.inline(F.array(*rows)))


@job
def contract_violations(opportunities: DataFrame, activities: DataFrame) -> DataFrame:
    named = {"opportunities": opportunities, "activities": activities}
    return reduce(DataFrame.unionByName, [check_contract(df, n, CONTRACTS[n]) for n, df in named.items()])


#: Violation types of the log, by rule.
VIOLATION_TYPES = {"missing": "missing_field", "type": "invalid_type", "required": "null_value", "range": "out_of_range", "allowed": "invalid_enum", "length": "too_long", "pattern": "invalid_format"}
#: The key field of each contract, whose repeats are ``duplicate`` violations, and the system it comes from.
CONTRACT_KEYS = {"opportunities": "opportunity_id", "activities": "activity_id"}
SOURCE_SYSTEMS = {"opportunities": "crm", "activities": "crm"}
SAMPLES = 5


def violation_hits(df: DataFrame, table: str, rules: tuple[FieldRule, ...]) -> DataFrame:
    """Every rule hit of every row melted into (contract, field, type, value) rows, and one row per repeat of the key."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    hits = []
    for r in rules:
        if r.name not in kinds:
            continue  # a missing field is one violation of the contract, not of rows; it is added in ``contract_violation_log``
        col = F.col(r.name)
        tests = {
            "type": F.lit(kinds[r.name] != r.dtype),
            "required": col.isNull() if r.required else None,
            "range": (col < r.low) | (col > r.high) if r.low is not None else None,
            "allowed": ~col.isin(*r.allowed) if r.allowed else None,
            "length": F.length(col) > r.longest if r.longest else None,
            "pattern": ~col.rlike(r.pattern) if r.pattern else None,
        }
        for rule, t in tests.items():
            if t is not None:
                hits.append(F.when(nvl(t, False), F.struct(F.lit(r.name).alias("field_name"), F.lit(VIOLATION_TYPES[rule]).alias("violation_type"), col.cast("string").alias("value"))))
    melted = df.select(F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("h.*") if hits else None
    key = CONTRACT_KEYS.get(table)
    if key in kinds:
        repeated = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
        dupes = repeated.select(F.lit(key).alias("field_name"), F.lit("duplicate").alias("violation_type"), F.col(key).cast("string").alias("value"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k")).drop("_k")
        melted = dupes if melted is None else melted.unionByName(dupes)
    return melted.withColumn("contract_name", F.lit(table)) if melted is not None else None


def contract_violation_log(tables: dict[str, DataFrame], *, as_of, build_id: str) -> DataFrame:
    """The nine columns of the violations log: one row per (contract, field, type) with hits, its count, the five least
    distinct offending values (nulls as 'null'), when and in which build it was found, and the source system.

    Counts come from map-side partial sums of the melted hits; the five samples from a row-number filter, which Spark
    cuts per task before the shuffle (window group limit).  ``violation_id`` is a hash of build, contract, field and type,
    so a rerun of one build gives the same rows.
    """
    hits = [h for t, df in tables.items() if (h := violation_hits(df, t, CONTRACTS[t])) is not None]
    missing = [(t, r.name) for t, df in tables.items() for r in CONTRACTS[t] if r.name not in df.columns]
    spark = next(iter(tables.values())).sparkSession
    keys = ["contract_name", "field_name", "violation_type"]
    values = reduce(DataFrame.unionByName, hits).withColumn("value", F.coalesce("value", F.lit("null"))).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    if missing:
        values = values.unionByName(spark.createDataFrame([(t, f, "missing_field", "absent", 1) for t, f in missing], "contract_name string, field_name string, violation_type string, value string, n long"))
    counts = values.groupBy(*keys).agg(F.sum("n").alias("violation_count"))
    first = values.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).where(f"_r <= {SAMPLES}")
    samples = first.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    source = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_SYSTEMS.items() for x in kv]), F.col("contract_name"))
    return counts.join(samples, keys).select(
        F.sha2(F.concat_ws("|", F.lit(build_id), *keys), 256).alias("violation_id"), *keys, "violation_count", "sample_values",
        F.lit(dt.datetime.combine(as_of, dt.time())).cast("timestamp_ntz").alias("detected_at"), source.alias("source_system"), F.lit(build_id).alias("build_id"),
    )


def append_violations(log: DataFrame, path: str) -> None:
    """Append one build's rows to the log table, partitioned by build: a rerun of the same build replaces its rows."""
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("build_id").parquet(path)


def recent_violations(spark, path: str, as_of) -> DataFrame:
    """The log's last seven days, largest counts first."""
    return spark.read.parquet(path).where(F.col("detected_at") >= F.lit(as_of - dt.timedelta(days=7))).orderBy(F.desc("violation_count"), "violation_id")


@job
def contract_violation_rows(opportunities: DataFrame, activities: DataFrame, *, as_of) -> DataFrame:
    return contract_violation_log({"opportunities": opportunities, "activities": activities}, as_of=as_of, build_id=f"build-{as_of:%Y%m%d}")

"""Merging sources, sums and ranks beyond small sizes, stored shared tables, alert messages."""

import datetime as dt

from pyspark.sql import functions as F

from settings import SF_SMALL
from quotaloom.functions.exprs import exact_avg, exact_sum
from quotaloom.functions.ordered import rank_from_counts
from quotaloom.operators.billing import filled
from quotaloom.operators.ingest import merged_accounts, merged_opportunities
from quotaloom.operators.matching import near_names
from quotaloom.plans.registry import Tables

DEALS = "opportunity_name string, opportunity_id long, account_id long, amount double, stage_name string, close_date date"
ACCOUNTS = "account_name string, account_id long, industry string, annual_revenue double, employee_count int, segment string"


def deals(spark, *rows):
    return spark.createDataFrame([(n, i, a, 1.0, "Proposal", dt.date(2001, 1, 1)) for n, i, a in rows], DEALS)


def test_merge_keeps_all_of_a_source_and_null_keys(spark):
    a = deals(spark, (" Big deal", 1, 7), ("big Deal ", 2, 7), ("Big deal", 3, 8), (None, 4, 7), (None, 5, None))
    b = deals(spark, ("BIG DEAL", 11, 7), ("Big deal", 12, 9), (None, 13, 7), ("only b", 14, 7), ("only b", 15, 7), ("big deal", 16, None))
    got = {(r.opportunity_id, r.source) for r in merged_opportunities(a, b).collect()}
    assert got == {(i, "CRM A") for i in (1, 2, 3, 4, 5)} | {(i, "CRM B") for i in (12, 13, 14, 15, 16)}


def test_accounts_merge_by_name(spark):
    make = lambda *rows: spark.createDataFrame([(n, i, "x", 1.0, 1, "SMB") for n, i in rows], ACCOUNTS)
    got = merged_accounts(make(("Acme ", 1), (None, 2)), make(("acme", 11), (None, 12), ("Globex", 13))).collect()
    assert {(r.account_id, r.source) for r in got} == {(1, "CRM A"), (2, "CRM A"), (12, "CRM B"), (13, "CRM B")}


def test_sums_and_averages_do_not_overflow(spark):
    big = spark.range(1000).select(F.lit(2e14).alias("x"), F.lit(-1.5).alias("y"))
    row = big.agg(exact_sum("x").alias("s"), exact_avg("x", 4).alias("a"), exact_sum("y").alias("n"), exact_avg("y").alias("m"), exact_sum("x", where=F.lit(False)).alias("z"), exact_avg("x", where=F.lit(False)).alias("none")).first()
    assert (row.s, row.a, row.n, row.m, row.z, row.none) == (2e17, 2e14, -1500.0, -1.5, 0.0, None)


def test_ranks_are_wide(spark):
    assert dict(rank_from_counts(spark.range(5).select(F.col("id").cast("double").alias("v")), "v", "r").dtypes)["r"] == "bigint"


def test_near_names_of_repeated_names(spark):
    left = spark.createDataFrame([(i, "northwind traders") for i in range(50)] + [(90, "else")], "id int, name string")
    right = spark.createDataFrame([(i + 7, "northwind trader") for i in range(50)], "id int, name string")
    got = near_names(left, right).collect()
    assert len(got) == 50 and {r.other_id for r in got} == {7}


def test_stored_tables_serve_the_same_rows(spark, tables, tmp_path):
    names = ("opportunities", "deal_health", "sales_reps")
    own = Tables(spark, SF_SMALL)
    own.materialise(str(tmp_path), names)
    again = Tables.stored(spark, str(tmp_path), SF_SMALL, names=names)
    for name in ("pipeline_health_summary", "rep_performance"):
        want = sorted(map(str, tables[name].collect()))
        assert sorted(map(str, own[name].collect())) == want and sorted(map(str, again[name].collect())) == want
    plan = again["pipeline_health_summary"]._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_message_templates(spark):
    text = filled("{value:.1%} of {threshold:.0f}, ${amount:,.0f} in {name}", {"value": F.lit(0.1234), "threshold": F.lit(60.0), "amount": F.lit(1234567.4), "name": F.lit(None).cast("string")})
    assert spark.range(1).select(text).first()[0] == "12.3% of 60, $1,234,567 in "


def test_build_success_shares_read_the_feed_statuses(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    rows = q["sql_week_build_success"](spark, "/root/testdata/sf0.01").collect()
    shares = [r.build_success_rate for r in rows]
    assert rows and 0 < sum(shares) / len(shares) < 1 and any(0 < s < 1 for s in shares)

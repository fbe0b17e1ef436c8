"""Interval join by bins against a plain theta join."""

import datetime as dt
import random

from quotaloom.functions.intervals import interval_join


def test_equals_theta_join_on_overlapping_open_and_touching_intervals(spark):
    r = random.Random(9)
    day = lambda n: dt.date(2001, 1, 1) + dt.timedelta(n)
    intervals = []
    for i in range(300):
        a = r.randrange(-100, 400)
        b = r.choice([None, a + r.randrange(0, 120), a - 5])
        intervals.append((i, r.choice(["x", "y", "z", None]), day(a), day(b) if b is not None else None))
    intervals += [(900, "x", day(10), day(40)), (901, "x", day(40), day(70)), (902, "x", None, day(5)), (903, "y", day(0), None)]
    points = [(j, r.choice(["x", "y", "z", "w", None]), day(r.randrange(-50, 450)) if r.random() > 0.02 else None) for j in range(500)]
    points += [(1000, "x", day(40)), (1001, "x", day(39)), (1002, "x", day(70))]
    p = spark.createDataFrame(points, "pid long, k string, t date")
    iv = spark.createDataFrame(intervals, "iid long, k string, s date, e date")
    for inclusive in (False, True):
        out = interval_join(p, iv, ["k"], "t", "s", "e", end_inclusive=inclusive)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = sorted((row.pid, row.iid) for row in out.collect())
        want = []
        for pid, k, t in points:
            hits = [iid for iid, ik, s, e in intervals if k is not None and ik == k and t is not None and s is not None and s <= t and (e is None or (t <= e if inclusive else t < e))]
            want += [(pid, i) for i in hits] or [(pid, None)]
        assert got == sorted(want, key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    assert {row.iid for row in interval_join(p, iv, ["k"], "t", "s", "e").where("pid = 1000").collect()} & {900, 901, 902} == {901}  # touching: the later one
    assert interval_join(p.limit(0), iv, ["k"], "t", "s", "e").count() == 0


def test_each_period_is_priced_by_the_step_and_book_row_of_its_own_time(spark):
    from quotaloom.operators.billing import invoice_lines_by_period, price_book, tenant_prices_by_period

    d = dt.date
    subs = spark.createDataFrame([(1, "growth", "monthly", 0, "EU", False), (2, "enterprise", "monthly", 0, "UK", False)], "tenant_id long, plan_code string, billing_interval string, discount_percent int, region string, has_tax_id boolean")
    usage = spark.createDataFrame([(t, "seats", p, 1, 1) for t in (1, 2) for p in ("2000-12", "2001-06", "2001-07")], "tenant_id long, meter string, period string, used long, records long")
    steps = spark.createDataFrame([(1, 1, d(2000, 12, 1), d(2001, 7, 1), "starter", None), (1, 2, d(2001, 7, 1), d(2002, 1, 1), "enterprise", 4200.0)], "tenant_id long, step int, start_date date, end_date date, plan_code string, price_override double")
    none = spark.createDataFrame([], "tenant_id long, add_on string, quantity int, deactivated_on date")
    over = spark.createDataFrame([], "tenant_id long, period string, meter string, used long, included long, overage long, unit_price double, total double")
    lines = {(r.tenant_id, r.period): (r.item, r.amount) for r in invoice_lines_by_period(subs, none, over, steps, usage).collect()}
    assert lines[(1, "2000-12")] == ("Starter", 499.0) and lines[(1, "2001-06")] == ("Starter", 499.0) and lines[(1, "2001-07")] == ("Enterprise", 4200.0)
    assert lines[(2, "2001-07")] == ("Enterprise", 4999.0)
    prices = {(r.tenant_id, r.period): (r.from_book, r.monthly_price) for r in tenant_prices_by_period(subs, price_book(spark), usage).collect()}
    # EU growth is in the book from 2001-01-01 on, UK enterprise until 2001-06-30 (inclusive)
    assert prices[(1, "2000-12")][0] is False and prices[(1, "2001-06")] == (True, 1399.0)
    assert prices[(2, "2001-06")] == (True, 3999.0) and prices[(2, "2001-07")][0] is False


def test_tenants_and_dealt_intervals_are_never_broadcast(spark, tables):
    from pyspark.sql import functions as F

    def broadcasts(df):
        return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")

    p = spark.createDataFrame([(1, "x", dt.date(2001, 5, 1))], "pid long, k string, t date")
    iv = spark.createDataFrame([(1, "x", dt.date(2001, 1, 1), None)], "iid long, k string, s date, e date")
    assert broadcasts(interval_join(p, iv, ["k"], "t", "s", "e")) == 0
    assert broadcasts(interval_join(p, F.broadcast(iv), ["k"], "t", "s", "e")) == 1  # asked for by the caller
    for name in ("invoice_lines_by_period", "tenant_prices_by_period", "overage_charges"):
        assert broadcasts(tables[name]) <= 1, name  # the literal dimension (plan limits, price book) alone

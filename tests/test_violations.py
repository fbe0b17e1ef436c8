"""Contract violations log: melted hits against plain Python, duplicates, samples, idempotent appends."""

import datetime as dt

from quotaloom.plans import quality

AS_OF = dt.date(2001, 12, 31)


def test_log_rows_equal_a_plain_count(spark, tmp_path):
    opps = spark.createDataFrame(
        [(1, "Deal a", 1, 1, 10.0, "Proposal", None, 5.0, AS_OF, 1.0), (1, "Bad", 1, None, -5.0, "Nope", "Pipeline", 150.0, AS_OF, 30.0), (2, "Deal b", None, 2, 1e9, "Proposal", "Best Case", 5.0, None, 0.0),
         (3, "Deal c", 3, 3, 5.0, "Closed Won", "Commit", 5.0, AS_OF, 26.0)],
        "opportunity_id bigint, opportunity_name string, account_id bigint, owner_id bigint, amount double, stage_name string, forecast_category string, win_probability double, close_date date, discount_percent double",
    )
    acts = spark.createDataFrame([(7, "Call", AS_OF, 500, "x"), (8, "Fax", AS_OF, 10, "y" * 300), (8, "Call", None, None, None)], "activity_id bigint, activity_type string, activity_date date, duration_minutes int, subject string")
    log = quality.contract_violation_log({"opportunities": opps, "activities": acts}, as_of=AS_OF, build_id="b1")
    rows = {(r.contract_name, r.field_name, r.violation_type): (r.violation_count, r.sample_values) for r in log.collect()}
    assert rows[("opportunities", "opportunity_id", "duplicate")] == (2, ["1"])
    assert rows[("opportunities", "owner_id", "null_value")] == (1, ["null"])
    assert rows[("opportunities", "amount", "out_of_range")][0] == 2
    assert rows[("opportunities", "stage_name", "invalid_enum")] == (1, ["Nope"])
    assert rows[("opportunities", "discount_percent", "out_of_range")] == (2, ["26.0", "30.0"])
    assert rows[("opportunities", "opportunity_name", "invalid_format")] == (1, ["Bad"])
    assert rows[("activities", "activity_type", "invalid_enum")] == (1, ["Fax"])
    assert rows[("activities", "activity_id", "duplicate")][0] == 2
    assert rows[("activities", "subject", "too_long")][0] == 1
    assert rows[("activities", "duration_minutes", "out_of_range")] == (1, ["500"])
    assert all(len(s) <= 5 for _, s in rows.values())
    path = str(tmp_path / "log")
    quality.append_violations(log, path)
    quality.append_violations(log, path)  # rerun of the same build adds nothing
    assert spark.read.parquet(path).count() == len(rows)
    quality.append_violations(quality.contract_violation_log({"opportunities": opps, "activities": acts}, as_of=AS_OF, build_id="b2"), path)
    assert spark.read.parquet(path).count() == 2 * len(rows)
    assert quality.recent_violations(spark, path, AS_OF + dt.timedelta(days=8)).count() == 0
    assert quality.recent_violations(spark, path, AS_OF).first().violation_count == max(c for c, _ in rows.values())


def test_many_samples_are_cut_to_the_five_least(spark):
    acts = spark.createDataFrame([(i, f"T{i % 50:02d}", AS_OF, 1, "s") for i in range(2000)], "activity_id bigint, activity_type string, activity_date date, duration_minutes int, subject string").repartition(7)
    opps = spark.createDataFrame([], "opportunity_id bigint")
    rows = {(r.contract_name, r.field_name, r.violation_type): (r.violation_count, r.sample_values) for r in quality.contract_violation_log({"opportunities": opps, "activities": acts}, as_of=AS_OF, build_id="b").collect()}
    assert rows[("activities", "activity_type", "invalid_enum")] == (2000, ["T00", "T01", "T02", "T03", "T04"])
    assert rows[("opportunities", "amount", "missing_field")][0] == 1

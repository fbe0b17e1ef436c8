"""Second runs with unchanged input, and updates of stored tables."""

import datetime as dt

from pyspark.sql import functions as F

from settings import AS_OF
from quotaloom.operators.commercial import baseline_update, health_trends, overage_events, stage_history
from quotaloom.operators.ingest import newest_wins
from quotaloom.operators.monitor import alert_update
from quotaloom.plans import quality
from quotaloom.sources.files import append_snapshot, newest_rows, read_export


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_overage_lines_are_not_doubled(tables):
    first = overage_events(tables["usage_summary"], None, AS_OF)
    assert rows(overage_events(tables["usage_summary"], first, AS_OF)) == rows(first)


def test_stage_history_is_idempotent_and_closes_once(tables):
    status = tables["implementation_status"]
    once = tables["implementation_history"]
    assert rows(stage_history(status, once, AS_OF)) == rows(once)
    assert once.filter("exited_at IS NULL").groupBy("customer_id").count().filter("count > 1").count() == 0


def test_alert_cooldown_and_resolution(tables):
    history = tables["alert_history"]
    live = history.filter("NOT is_resolved AND alert_type = 'stale_pipeline'").groupBy("customer_id").count()
    assert live.filter("count > 1").count() == 0
    again = alert_update(history.filter("message <> 'stored'").filter("NOT is_resolved"), history, AS_OF)
    fresh = history.filter(F.col("triggered_at") > F.lit("2001-12-31 23:00:00").cast("timestamp_ntz"))
    assert fresh.count() > 0 and again.count() >= history.count()
    assert history.filter("is_resolved AND resolved_at IS NULL").count() == 0


def test_weekly_trend_keeps_newest(tables):
    scores = tables["tenant_health_scores"]
    once = tables["tenant_health_trends"]
    assert rows(health_trends(scores, once.drop("prev_score", "score_change", "trend_direction"), AS_OF)) == rows(once)


def test_roi_baseline_is_captured_once(tables):
    base = tables["tenant_roi_baseline"]
    assert rows(baseline_update(tables["opportunities"], tables["implementation_status"], base, AS_OF)) == rows(base)


def test_upsert_takes_newer_and_keeps_the_rest(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "stale", 5), (2, "c", 25), (3, "d", 30)], "id int, v string, at int")
    assert rows(newest_wins(old, new, "id", "at")) == rows(spark.createDataFrame([(1, "a", 10), (2, "c", 25), (3, "d", 30)], "id int, v string, at int"))
    assert newest_wins(old.limit(0), new, "id", "at").count() == 3
    assert rows(newest_rows(old.unionByName(new), "id", "at")) == rows(newest_wins(old, new, "id", "at"))


def test_quality_checks_pass_and_fail(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", -1.0, "y"), (None, None, "z")], "k string, n double, c string")
    got = {r["check"]: r["passed"] for r in quality.run_checks(df, [
        quality.row_count(), quality.row_count(1, 2), quality.no_nulls("k"), quality.no_nulls("c"), quality.null_rate("k", 0.5), quality.values_in("c", ["x", "y"]),
        quality.positive("n"), quality.in_range("n", -5, 5), quality.matches("c", "^[xyz]$"), quality.longest("c", 1), quality.implies("pos_has_key", F.col("n") > 0, F.col("k").isNotNull()),
    ][1:]).collect()}
    assert got == {
        "row_count": False, "no_nulls_k": False, "no_nulls_c": True, "null_rate_k": True, "values_in_c": False, "positive_n": False, "in_range_n": True, "matches_c": True, "length_c": True, "pos_has_key": True,
    }
    assert quality.unique_key(df, "c").collect()[0]["passed"] and not quality.unique_key(df, "k").collect()[0]["passed"]
    ref = spark.createDataFrame([("x",), ("y",)], "ref string")
    assert quality.foreign_key(df, "c", ref, "ref").collect()[0]["observed"] == 1.0
    assert [r[0] for r in quality.invalid_sample(df, "c", ["x"]).collect()] == ["y", "z"]
    good, bad = quality.split_rows(df, F.col("n") > 0)
    assert (good.count(), bad.count()) == (1, 2)
    assert quality.columns_exist(df, "k", "q") == ["q"]
    try:
        quality.enforce(quality.run_checks(df, [quality.no_nulls("k")]), "t")
        raise AssertionError("expected a failure")
    except quality.QualityError as e:
        assert "no_nulls_k = 1" in str(e)


def test_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("1,2.5\nx,oops\n")
    got = read_export(spark, str(tmp_path / "in.csv"), "id int, amount double", "csv").orderBy("_corrupt_record").collect()
    assert [r["_corrupt_record"] for r in got] == [None, "x,oops"]
    out = str(tmp_path / "snap")
    day = lambda d, n: spark.range(n).withColumn("snapshot_date", F.lit(dt.date(2001, 1, d)))
    append_snapshot(day(1, 3), out)
    append_snapshot(day(2, 2), out)
    append_snapshot(day(2, 2), out)
    assert spark.read.parquet(out).count() == 5

"""Streams drained with availableNow against the batch form of the same job."""

import pytest
from pyspark.sql import functions as F

from quotaloom.sources.files import newest_rows
from quotaloom.streaming import feeds


def drain(df, spark, path, mode="append"):
    out, ckpt = str(path / "out"), str(path / "ckpt")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def as_stream(df, spark, path, files=1):
    src = str(path / "src")
    df.repartition(files).write.parquet(src)
    return spark.readStream.schema(df.schema).parquet(src)


def test_daily_usage_equals_batch(spark, tables, tmp_path):
    # A row far ahead closes every earlier day, as later traffic would.
    events = tables["product_events"].withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    flush = events.limit(1).withColumn("event_timestamp", F.lit("2010-01-01 00:00:00").cast("timestamp"))
    src = tmp_path / "src"
    events.write.parquet(str(src / "a"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(src))
    got = drain(feeds.daily_active_usage(stream), spark, tmp_path)
    flush.write.parquet(str(src / "b"))
    got = drain(feeds.daily_active_usage(stream), spark, tmp_path).filter("usage_date < '2009-01-01'")
    want = events.groupBy("account_id", F.to_date("event_timestamp").alias("usage_date")).agg(F.count_distinct("user_id").alias("u"), F.count("*").alias("n"))
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert key(got, "account_id", "usage_date", "daily_active_users", "total_events") == key(want, "account_id", "usage_date", "u", "n")


def test_upsert_equals_newest(spark, tables, tmp_path):
    changes = tables["staging_opportunities"].select("opportunity_id", "amount", "last_modified_date")
    moved = changes.withColumns({"amount": F.col("amount") + 1, "last_modified_date": F.date_add("last_modified_date", 5)}).filter("opportunity_id % 3 = 0")
    both = changes.unionByName(moved)
    stream = as_stream(both, spark, tmp_path, 3).select("*")
    feeds.upsert_changes(stream, str(tmp_path / "t"), "opportunity_id", "last_modified_date", str(tmp_path)).awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("opportunity_id", "amount", "last_modified_date").collect()))
    assert key(feeds.upserted(spark, str(tmp_path / "t"), both.schema)) == key(newest_rows(both, "opportunity_id", "last_modified_date"))


def test_cooldown_drops_repeats(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 10:00:00"), ("a", 1, "2024-01-01 10:20:00"), ("a", 2, "2024-01-01 10:20:00"), ("b", 1, "2024-01-01 10:30:00")]
    df = spark.createDataFrame(rows, "alert_type string, customer_id int, t string").select("alert_type", "customer_id", F.to_timestamp("t").alias("triggered_at"))
    assert drain(feeds.alert_cooldown(as_stream(df, spark, tmp_path)), spark, tmp_path).count() == 3


def test_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 12:00:00"), (9, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "account_id int, t string").select("account_id", F.to_timestamp("t").alias("event_time"))
    stream = as_stream(df, spark, tmp_path)
    query = feeds.touch_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["touches"] for r in spark.table("sessions").filter("account_id = 1").collect()) == [1, 2]


def test_checkpoint_root(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            feeds.checkpoint_root(spark)


def test_upsert_touches_only_its_buckets_and_can_be_replayed(spark, tmp_path):
    schema = "customer_id int, deal_id int, amount double, synced_at int"
    first = [(c, d, 1.0, 1) for c in range(5) for d in range(8)]
    second = [(0, 3, 2.0, 2), (7, 3, 2.0, 2), (0, 4, 9.0, 0)]
    src, table = str(tmp_path / "in"), str(tmp_path / "deals")
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        feeds.upsert_changes(stream, table, ("customer_id", "deal_id"), "synced_at", str(tmp_path / "c"), buckets=8).awaitTermination()
    df = feeds.upserted(spark, table, stream.schema)
    want = {(c, d): 1.0 for c, d, *_ in first} | {(0, 3): 2.0, (7, 3): 2.0}
    assert {(r.customer_id, r.deal_id): r.amount for r in df.collect()} == want and df.count() == len(want)
    assert len(list((tmp_path / "deals" / "v1").glob("_bucket=*"))) <= 3
    again = feeds.bucket_versions(spark, table, 1)
    assert set(again.values()) == {0}


def test_sliding_usage_and_late_rows(spark, tmp_path):
    rows = [(1, u, f"2024-01-{d:02d} 10:00:00") for u, d in ((1, 1), (2, 3), (1, 5), (3, 20))]
    df = spark.createDataFrame(rows, "account_id int, user_id int, t string").select("account_id", "user_id", F.to_timestamp("t").alias("event_timestamp"))
    query = feeds.sliding_usage(as_stream(df, spark, tmp_path)).writeStream.format("memory").queryName("sliding").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r.from_date), r.weekly_active_users, r.total_events) for r in spark.table("sliding").collect()}
    assert ("2024-01-01", 2, 3) in got and ("2023-12-28", 2, 2) in got
    assert feeds.late_rows(query) == 0


def test_touch_stream_feeds_sessions(spark):
    at = lambda name: spark.createDataFrame([(1, "2024-01-01 10:00:00")], "account_id int, t string").select("account_id", F.to_timestamp("t").alias(name))
    both = feeds.touch_stream(at("touch_date"), at("activity_date"))
    assert both.columns == ["account_id", "event_time", "team"]
    assert feeds.touch_sessions(both).first()["touches"] == 2


def test_alert_lifecycle_fires_once_an_hour_and_resolves_after_a_quiet_day(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1, 10)
    minutes = {("a", 1): [0, 20, 61, 200, 2000, 2010, 3600 + 2000], ("a", 2): [5], ("b", 1): [30, 31, 32]}
    rows = [(k, c, base + dt.timedelta(minutes=m)) for (k, c), ms in minutes.items() for m in ms]
    schema = "alert_type string, customer_id long, triggered_at timestamp"
    stream = as_stream(spark.createDataFrame(rows, schema), spark, tmp_path, 3)
    drain(feeds.alert_lifecycle(stream), spark, tmp_path)
    # a later alert moves the watermark on, so quiet alerts resolve without rows of their own
    spark.createDataFrame([("z", 99, base + dt.timedelta(days=30))], schema).write.mode("append").parquet(str(tmp_path / "src"))
    got = drain(feeds.alert_lifecycle(stream), spark, tmp_path)
    got = sorted((r.alert_type, r.customer_id, r.event, r.at) for r in got.collect() if r.alert_type != "z")
    want = []
    for (k, c), ms in minutes.items():
        fired = seen = None
        for t in sorted(base + dt.timedelta(minutes=m) for m in ms):
            if seen is not None and t > seen + dt.timedelta(hours=24):
                want.append((k, c, "resolved", seen + dt.timedelta(hours=24)))
                fired = None
            if fired is None or t >= fired + dt.timedelta(hours=1):
                want.append((k, c, "fired", t))
                fired = t
            seen = t
        want.append((k, c, "resolved", seen + dt.timedelta(hours=24)))
    assert got == sorted(want)

"""Structured Streaming forms of jobs that are incremental by nature."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quotaloom.functions.exprs import tally
from quotaloom.sources.files import newest_rows


def checkpoint_root(spark: SparkSession) -> str:
    """Checkpoint folder the cluster names."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    raise ValueError("set spark.checkpoint.dir to a shared folder")


def daily_active_usage(product_events: DataFrame, late: str = "2 days") -> DataFrame:
    """Activity per account and day; exact distinct counts are not possible on streams."""
    name = F.col("event_name")
    return (
        product_events.withWatermark("event_timestamp", late)
        .groupBy("account_id", F.window("event_timestamp", "1 day").alias("w"))
        .agg(
            F.approx_count_distinct("user_id").alias("daily_active_users"), F.count("*").alias("total_events"),
            tally(name.contains("core")).alias("core_feature_events"), tally(name.contains("premium")).alias("premium_feature_events"),
        )
        .select("account_id", F.to_date("w.start").alias("usage_date"), "daily_active_users", "total_events", "core_feature_events", "premium_feature_events")
    )


def daily_user_sketches(product_events: DataFrame, late: str = "2 days", lg_k: int = 12) -> DataFrame:
    """Per account and day a mergeable sketch of its users, appended once the watermark passes the day; the batch
    ``merged_active_users`` turns stored sketches into 7 and 30 day counts."""
    return (
        product_events.withWatermark("event_timestamp", late)
        .groupBy("account_id", F.window("event_timestamp", "1 day").alias("w"))
        .agg(F.hll_sketch_agg("user_id", lg_k).alias("users"), F.count("*").alias("events"))
        .select("account_id", F.to_date("w.start").alias("usage_date"), "users", "events")
    )


def alert_cooldown(alerts: DataFrame, cooldown: str = "1 hour") -> DataFrame:
    """At most one alert per type and tenant within the cooldown."""
    return alerts.withWatermark("triggered_at", cooldown).dropDuplicatesWithinWatermark(["alert_type", "customer_id"])


def touch_sessions(touches: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Customer sessions over the merged touch stream."""
    return (
        touches.withWatermark("event_time", late)
        .groupBy("account_id", F.session_window("event_time", gap).alias("s"))
        .agg(F.count("*").alias("touches"), F.min("event_time").alias("started_at"), F.max("event_time").alias("ended_at"))
        .drop("s")
    )


def upsert_changes(changes: DataFrame, table: str, key: str | Sequence[str], changed_at: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Newest-wins upsert of a change stream into a parquet table, by one key column or several.

    Rows lie in buckets by a hash of the key.  A batch rewrites the buckets it touches into a version of its own and
    notes the version of every bucket, so its cost follows the batch, and a replayed batch rewrites its own version.
    """
    keys = [key] if isinstance(key, str) else list(key)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most ``buckets``
        versions = bucket_versions(spark, table, batch_id) if batch_id else {}
        known = [f"{table}/v{versions[b]}/_bucket={b}" for b in sorted(touched & versions.keys())]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*known)) if known else batch
        merged = newest_rows(rows, keys, changed_at).select(*batch.columns, bucket.alias("_bucket"))
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/v{batch_id}")
        noted = spark.createDataFrame(sorted((versions | dict.fromkeys(touched, batch_id)).items()), "bucket int, version long")
        noted.coalesce(1).write.mode("overwrite").parquet(f"{table}/_versions/batch={batch_id}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", os.path.join(checkpoint, "upsert")).trigger(availableNow=True).start()


def bucket_versions(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """Version of every bucket after the newest batch, or the newest one before a batch."""
    noted = spark.read.schema("bucket int, version long, batch long").parquet(f"{table}/_versions")
    if before is not None:
        noted = noted.filter(F.col("batch") < before)
    return {r["bucket"]: r["version"] for r in noted.filter(F.col("batch") == noted.agg(F.max("batch")).scalar()).collect()}


def upserted(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """Current rows of a table that ``upsert_changes`` keeps."""
    return spark.read.schema(schema).parquet(*(f"{table}/v{v}/_bucket={b}" for b, v in sorted(bucket_versions(spark, table).items())))


def sliding_usage(product_events: DataFrame, late: str = "2 days") -> DataFrame:
    """Activity per account over seven days, every day anew."""
    return (
        product_events.withWatermark("event_timestamp", late)
        .groupBy("account_id", F.window("event_timestamp", "7 days", "1 day").alias("w"))
        .agg(F.approx_count_distinct("user_id").alias("weekly_active_users"), F.count("*").alias("total_events"))
        .select("account_id", F.to_date("w.start").alias("from_date"), F.to_date("w.end").alias("to_date"), "weekly_active_users", "total_events")
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that the last batches dropped as later than the watermark allows."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def touch_stream(marketing: DataFrame, sales: DataFrame) -> DataFrame:
    """Both teams' touches as one stream of (account_id, event_time, team), for ``touch_sessions``."""
    one = lambda df, at, team: df.select("account_id", F.col(at).alias("event_time"), F.lit(team).alias("team"))
    return one(marketing, "touch_date", "marketing").unionByName(one(sales, "activity_date", "sales"))


ALERT_STATE = "last_fired timestamp, last_seen timestamp"
ALERT_EVENTS = "alert_type string, customer_id long, event string, at timestamp"


def alert_lifecycle(alerts: DataFrame, cooldown: str = "1 hour", resolve_after: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Keyed state per (alert_type, customer_id): an alert fires at most once per ``cooldown``, and the open alert is
    resolved once ``resolve_after`` passes without a recurrence (an event-time timeout, so it also fires in batches
    without new rows).  Rows: (alert_type, customer_id, event 'fired' or 'resolved', at).  After a resolution the next
    alert of the key fires again.  Rows later than the watermark are dropped by Spark, as everywhere on streams.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    gap, quiet = pd.Timedelta(cooldown), pd.Timedelta(resolve_after)

    def step(key, frames, state):
        kind, customer = key
        if state.hasTimedOut:
            _, last_seen = state.get
            state.remove()
            yield pd.DataFrame({"alert_type": [kind], "customer_id": [customer], "event": ["resolved"], "at": [pd.Timestamp(last_seen) + quiet]})
            return
        last_fired, last_seen = (pd.Timestamp(x) if x is not None else None for x in state.get) if state.exists else (None, None)
        fired, resolved = [], []
        times = sorted(t for f in frames for t in pd.to_datetime(f["triggered_at"]))
        for t in times:
            if last_seen is not None and t > last_seen + quiet:  # a quiet day inside the rows of one batch
                resolved.append(last_seen + quiet)
                last_fired = None
            if last_fired is None or t >= last_fired + gap:
                fired.append(t)
                last_fired = t
            last_seen = t if last_seen is None else max(last_seen, t)
        if last_seen is not None:
            state.update((last_fired.to_pydatetime(), last_seen.to_pydatetime()))
            state.setTimeoutTimestamp(int((last_seen + quiet).timestamp() * 1000))
        if fired or resolved:
            events = ["fired"] * len(fired) + ["resolved"] * len(resolved)
            yield pd.DataFrame({"alert_type": [kind] * len(events), "customer_id": [customer] * len(events), "event": events, "at": fired + resolved})

    keyed = alerts.select("alert_type", F.col("customer_id").cast("long"), "triggered_at").withWatermark("triggered_at", late)
    return keyed.groupBy("alert_type", "customer_id").applyInPandasWithState(step, ALERT_EVENTS, ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout)

"""Reading CRM exports with a declared schema and writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def read_export(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """CSV, JSON or Parquet export; unreadable text rows keep their source line."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(f"{schema}, {CORRUPT} string").load(path)
    return reader.schema(schema).load(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_snapshot(df: DataFrame, path: str, snapshot: str = "snapshot_date") -> None:
    """Replace only the partitions of the written snapshots, so reruns are idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(snapshot).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Co-locate a large table on its join key for repeated joins."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def newest_rows(df: DataFrame, key: str | Sequence[str], changed_at: str) -> DataFrame:
    """Newest version per key (one column or several)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(changed_at)).alias("r")).select(*keys, "r.*")

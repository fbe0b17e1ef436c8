"""Helpers shared by the training-data operators: inputs, stored intermediates, Arrow passes, components.

Conventions of all operators here: they select the columns they name, so further columns (even with the
names of results) are ignored; a null text counts as an empty one; rows are never dropped silently.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARROW_ROWS = 500
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediates (``spark.checkpoint.dir``).

    Where none is configured, a folder of our own is made only in local mode, where driver and executors share one
    machine; on a cluster a machine-local folder would lose what executors wrote, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quotaloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write are given back as soon as it is done.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of bounded rows (Spark bounds their bytes as well)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives buffers back, where the default pool keeps them
        return fn(batches)

    return df.mapInArrow(lean, schema)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def slices(texts: Sequence[str], chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters, so that lists of words stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Forest:
    """Union-find over the nodes of one task's block."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart; the smaller root stays."""
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a
        return a != b

    def stars(self) -> pa.Table:
        """(a, b): each node b with the smallest node a of its tree."""
        links = [(r, x) for x in list(self.parent) if (r := self.root(x)) != x]
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable from each node of the undirected ``edges``.

    Large-star / small-star: each round relinks every node to the smallest of its neighbours until nothing changes;
    rounds grow with the logarithm of the longest chain.  Neighbours of a hub are combined by min before the
    shuffle, never collected.  Each round is stored, so a lost executor repeats one round only.  Null ends are no edges.
    """
    cur = edges.select(F.least(col(a), col(b)).alias("lo"), F.greatest(col(a), col(b)).alias("hi")).where("lo < hi").distinct()
    cur = store(cur, name)
    before = None
    while True:
        # large star: every larger neighbour of x links to the smallest of x and its neighbours
        both = cur.select(F.col("lo").alias("x"), F.col("hi").alias("y")).unionAll(cur.select(F.col("hi").alias("x"), F.col("lo").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = cur.join(least.withColumnRenamed("x", "lo"), "lo").select(F.col("hi").alias("x"), F.col("m").alias("y"))
        # small star: every smaller neighbour of x, and x, link to the smallest of them
        large = large.where("x > y")
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct(F.col("y").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("x").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        cur = store(small.select("e.lo", "e.hi").where("lo < hi").distinct(), name)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = cur.groupBy("hi").agg(F.min("lo").alias("component"))
    return roots.select(F.col("hi").alias("node"), "component").unionAll(cur.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())

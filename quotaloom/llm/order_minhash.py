"""Order MinHash fingerprints: signatures that follow edit distance, not only shared k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import arrow_pass, col, strings
from .hashing import U, mix

POSITION_BITS = 24


class OrderMinHash:
    """``sketches`` orders; of each, the two least occurrence-numbered ``k``-mers, in text order, hashed to 16 bits.

    Equal k-mers are told apart by a running number, so repeats count.  A text shorter than ``k`` is one item.
    """

    def __init__(self, k: int = 8, sketches: int = 64, block: int = 1 << 14):
        if k & (k - 1):
            raise ValueError("k has to be a power of two")
        self.k, self.sketches, self.block = k, sketches, block
        self.factor = (mix(np.arange(1, sketches + 1, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
        self.rows = np.arange(sketches)

    def items(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hash of k-mer and occurrence number, position) in an order that depends on the text alone."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        n = len(points)
        base, h, width = U(0x9E3779B97F4A7C15), mix(points + U(1)), 1
        if n < self.k:
            return mix(np.array([int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")], U)), np.zeros(1, np.int64)
        with np.errstate(over="ignore"):
            while width < self.k:  # a k-mer from its two halves
                h = h[:-width] * base + h[width:]
                base, width = base * base, 2 * width
        low = U((1 << POSITION_BITS) - 1)
        h = mix(h) & ~low  # at every length, so that long and short texts have the same items
        if len(h) < 1 << POSITION_BITS:
            packed = np.sort(h | np.arange(len(h), dtype=U))
            position, h = (packed & low).astype(np.int64), packed & ~low
        else:
            position = np.argsort(h, kind="stable")
            h = h[position]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        number = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
        return mix(h + number.astype(U)), position

    def values(self, text: str) -> np.ndarray:
        items, position = self.items(text)
        small, top, best, at = (items >> U(32)).astype(np.uint32), np.uint32(0xFFFFFFFF), [], []
        with np.errstate(over="ignore"):
            for lo in range(0, len(small), self.block):
                order = small[None, lo : lo + self.block] * self.factor[:, None]
                for _ in range(min(2, order.shape[1])):
                    i = order.argmin(1)
                    best.append(order[self.rows, i])
                    at.append(i + lo)
                    order[self.rows, i] = top
        if len(best) == 1:
            one = other = items[at[0]]
        else:
            if len(best) > 2:
                order = np.array(best)
                pick = order.argsort(0, kind="stable")[:2]
                at = np.take_along_axis(np.array(at), pick, 0)
            swap = position[at[0]] > position[at[1]]
            one, other = items[np.where(swap, at[1], at[0])], items[np.where(swap, at[0], at[1])]
        return (mix(one * U(3) + other) >> U(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the orders in which two signatures agree."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 8, sketches: int = 64) -> DataFrame:
    """(id, n_chars, fingerprint) of every text; null counts as empty.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omh = OrderMinHash(k, sketches)
        for batch in batches:
            texts = strings(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([omh.values(t).tobytes().hex() for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    few = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    out = arrow_pass(few, run, f"id {few.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string")
    return out.select(F.col("id").alias(id_col), "n_chars", "fingerprint")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, role, id, h, text): rows dealt out by ranges of the order (id, h, text), null ids last.

    role 0: a row; role 1: a copy of the first row of the following bucket, so that within a bucket every row has the
    next row after it.  The driver sees the first (id, h) of each bucket only, at most ``2 * buckets`` pairs.
    """
    keyed = docs.withColumn("h", F.xxhash64("text"))
    ids = docs.select("id").where("id is not null")
    bounds = sorted(r[0] for r in ids.repartitionByRange(buckets, "id").groupBy(F.spark_partition_id()).agg(F.min("id")).select("min(id)").collect())

    @F.pandas_udf(LongType())
    def by_bound(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds), ids.to_numpy(), side="right") if bounds else 0, index=ids.index, dtype="int64")

    of_null = F.lit(len(bounds) + 1) + F.floor((F.shiftright("h", 40) + 2**23) * buckets / 2**24)  # by ranges of h
    some = keyed.where("id is not null").withColumn("bucket", by_bound("id"))
    none = keyed.where("id is null").withColumn("bucket", of_null.cast("long"))
    dealt = some.unionByName(none)
    firsts = dealt.select("bucket", "id", "h").groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("f")).select("bucket", "f.id", "f.h").collect()
    firsts = sorted(firsts, key=lambda r: r["bucket"])
    before = [(firsts[i - 1]["bucket"], r["id"], r["h"]) for i, r in enumerate(firsts)]
    links = docs.sparkSession.createDataFrame(before, f"before long, fid {docs.schema['id'].dataType.simpleString()}, fh long")
    marked = dealt.join(F.broadcast(links), (F.col("h") == F.col("fh")) & F.col("id").eqNullSafe(F.col("fid")), "left")
    places = F.array(F.struct("bucket", F.lit(0).alias("role")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("role")))
    return marked.select(F.explode(F.filter(places, lambda p: p["bucket"].isNotNull())).alias("p"), "id", "h", "text").select("p.*", "id", "h", "text")


def edit_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 8, sketches: int = 64) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last floor(n_chars/2) code points give way to
    the first as many (or all) of the next document's; after the last document comes the first.

    Documents are ordered by id, null ids last; rows of equal ids by xxhash64 of the text and the text.  The texts are
    shuffled once, into ranges of that order, and stream through their task in it: each fingerprint is made once and
    compared with the next.  Null or empty text: the fingerprint of the empty text; a single document is its own next.
    Empty table: no rows.  Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omh, rows = OrderMinHash(k, sketches), []
        bucket, before, closed = None, None, False
        for batch in batches:
            for b, role, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "role", "id", "text"))):
                if b != bucket:
                    bucket, before, closed = b, None, False
                if closed:
                    continue
                mark = omh.values(text)
                if before:
                    own, previous, mark0 = before
                    n = len(previous)
                    edited = previous[: n - n // 2] + text[: n // 2]
                    mark1 = omh.values(edited)
                    rows.append((own, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark0.tobytes().hex(), mark1.tobytes().hex(), likeness(mark0, mark1), likeness(mark0, mark)))
                before, closed = (doc, text, mark), role == 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds(batch))], names=names)
                rows = []

    def kinds(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [batch.schema.field("id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    few = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(few, 4 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "role", F.asc_nulls_last("id"), "h", "text")
    out = arrow_pass(dealt, run, f"id {few.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.col("id").alias(id_col), *names[1:])

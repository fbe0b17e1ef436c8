"""Embedding near-duplicates: iterative quantisation to binary codes, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, arrow_pass, col, components, store


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


class ItqIndex:
    """``tables`` substrings of ``width`` bits; the bits come from rotations learned for balanced codes.

    Each rotation yields as many bits as the vectors have components.  The vectors are not shifted to a mean of zero: the
    threshold is an angle at the origin, and only planes through it part a close pair seldom.  Sizes of vectors that the sample did not hold get
    random rotations, so that every vector is indexed.
    """

    def __init__(self, sample: np.ndarray, width: int, tables: int, rounds: int = 30, seed: int = 11):
        self.width, self.tables, self.rounds, self.seed = width, tables, rounds, seed
        self.planes: dict[int, np.ndarray] = {}
        if len(sample):
            self.planes[sample.shape[1]] = self._fit(sample)

    def _rotations(self, d: int) -> Iterator[np.ndarray]:
        rng = np.random.default_rng(self.seed)
        for _ in range(-(-self.width * self.tables // d)):
            yield np.linalg.qr(rng.standard_normal((d, d)))[0]

    def _fit(self, sample: np.ndarray) -> np.ndarray:
        x = unit(sample)
        basis = np.linalg.svd(x.T @ x)[0]  # principal directions
        v, found = x @ basis, []
        for r in self._rotations(x.shape[1]):
            for _ in range(self.rounds):  # codes for the rotation, then the rotation for the codes
                left, _, right = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
                r = left @ right
            found.append(basis @ r)
        return np.hstack(found)[:, : self.width * self.tables]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(n, tables) numbers of ``width`` bits, of unit vectors."""
        d = vectors.shape[1]
        if d not in self.planes:
            self.planes[d] = np.hstack(list(self._rotations(d)))[:, : self.width * self.tables]
        bits = (vectors @ self.planes[d] >= 0).reshape(len(vectors), self.tables, self.width)
        return bits @ (1 << np.arange(self.width))


def index_shape(rows: int, cosine: float, recall: float = 0.985, bucket: int = 64) -> tuple[int, int]:
    """(width, tables): buckets of about ``bucket`` vectors, and as many tables as pairs at the threshold need to meet in
    one of them with probability ``recall`` if every bit were a random hyperplane."""
    width = min(24, max(8, math.ceil(math.log2(max(rows, 1) / bucket))))
    same = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - same))


def in_block(cosine: float):
    """Numbers of links and joining edges within one pair of blocks of a bucket."""

    def run(group: pa.Table) -> pa.Table:
        h, n, side, table = (group.column(c).to_numpy() for c in ("h", "n", "side", "table"))
        x = unit(np.array(group.column("embedding").to_pylist(), np.float64))
        codes = np.array(group.column("codes").to_pylist())[:, : table[0]]  # of earlier tables
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if side.any() else a
        i, j = np.nonzero(x[a] @ x[b].T >= cosine)
        i, j = a[i], b[j]
        if not side.any():
            i, j = i[i < j], j[i < j]
        new = ~(codes[i] == codes[j]).any(1)  # a pair counts in the first table where it meets
        i, j = i[new], j[new]
        links = np.bincount(i, n[j], len(h)) + np.bincount(j, n[i], len(h))
        forest = Forest()
        for p, q in zip(h[i].tolist(), h[j].tolist()):
            forest.join(p, q)
        stars = forest.stars()
        some = np.flatnonzero(links)
        columns = {
            "h": pa.chunked_array([pa.array(h[some]), *stars.column("a").chunks]), "links": pa.array(np.r_[links[some].astype(np.int64), np.zeros(len(stars), np.int64)]),
            "other": pa.chunked_array([pa.nulls(len(some), pa.int64()), *stars.column("b").chunks]),
        }
        return pa.table(columns)

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, sample: int = 20_000, block: int = 1024) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; rows link when labels are equal and the cosine, in double
    precision, is at least ``cosine``.

    The rotation is learned on about ``sample`` vectors; every vector is indexed.  Vectors meet in a bucket when a
    substring of their codes is equal; all that meet are compared exactly, so no link found is wrong.  Buckets are cut
    into blocks and compared pair of blocks by pair of blocks, each in a bounded group that emits counts and a spanning
    forest, never pairs.  The substrings' width grows with the number of rows, their number with the width (see
    ``index_shape``), so that buckets keep their size.  Equal vectors of a label are one class and link among themselves.

    Null labels; null or zero vectors and those with null or non-finite components: no links, their own component.
    Vectors of different sizes do not link.  Null ids take part but name no component; repeated ids are rows of their
    own.  Empty table: no rows.
    """
    rows = vectors.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("embedding"), col(label_col).cast("string").alias("label"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(whole & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("h", F.when(usable, F.xxhash64("label", "embedding")))
    classes = store(rows.where("h is not null").groupBy("h", "label", "embedding").agg(F.count("*").alias("n")), "itq-classes")
    total, labels = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    width, tables = index_shape(total // max(labels, 1), cosine)
    share = F.lit(min(1.0, sample / max(total, 1)) * 1e6)
    chosen = classes.where(F.pmod(F.xxhash64(F.lit("itq"), "h"), F.lit(10**6)) < share).select("embedding").toArrow().column(0).to_pylist()
    size = max({len(v) for v in chosen}, key=[len(v) for v in chosen].count, default=0)
    index = ItqIndex(np.array([v for v in chosen if len(v) == size], np.float64), width, tables)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, codes = batch.column("embedding").to_pylist(), [None] * batch.num_rows
            for d in {len(v) for v in every}:
                at = [i for i, v in enumerate(every) if len(v) == d]
                for i, c in zip(at, index.codes(unit(np.array([every[i] for i in at], np.float64))).tolist()):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "label", "n", "embedding")), pa.array(codes, pa.list_(pa.int32()))], names=["h", "label", "n", "embedding", "codes"])

    with_codes = store(arrow_pass(classes.select("h", "label", "n", "embedding"), coded, "h long, label string, n long, embedding array<double>, codes array<int>"), "itq-codes")
    placed = with_codes.select("*", F.size("embedding").alias("d"), F.posexplode("codes").alias("table", "code"))
    bucket = ["table", "label", "d", "code"]
    large = placed.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > block)
    placed = placed.join(large, bucket, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block).cast("int"), F.lit(1)))
    meets = placed.withColumn("own", F.pmod(F.xxhash64("h"), "blocks").cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = meets.select(*bucket, F.least("own", "to").alias("lo"), F.greatest("own", "to").alias("hi"), (F.col("own") > F.col("to")).cast("int").alias("side"), "h", "n", "embedding", "codes")
    found = store(dealt.groupBy(*bucket, "lo", "hi").applyInArrow(in_block(cosine), "h long, links long, other long"), "itq-links")
    links = found.where("other is null").groupBy("h").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null"), "h", "other", "itq-components")
    ids = rows.where("h is not null").groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    named = ids.join(links, "h", "left").join(roots.withColumnRenamed("node", "h"), "h", "left")
    named = store(named.select("h", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "h").alias("root")), "itq-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = store(named.join(least, "root").select("h", "n_links", "component_id"), "itq-result")
    out = rows.select("id", "h").join(by_class, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

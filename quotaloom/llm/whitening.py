"""Embedding whitening by polarisation: exact covariances from squared sums of centred values.

Vectors become whole numbers x = floor(scale * c) + offset.  With n vectors and per-dimension sums S, the centred
value scaled by n, D = n*x - S, is a whole number.  Each task sums D_a^2 for every dimension a and (D_a + D_b)^2
for every pair a < b exactly (three 21-bit limbs, so no product leaves 64 bits; totals as decimal(38,0)).  By
polarisation, sum D_a D_b = ((D_a + D_b)^2 - D_a^2 - D_b^2) / 2, so every covariance V_ab = sum D_a D_b / n^3 is
exact before its one rounding to double.  The d x d matrix (d dimensions, not rows) goes to ``numpy.linalg.eigh``.

Data passes: counts, sums and ranges per dimension; the squared sums; the whitened values and their own covariance
(for ``identity_error``); the rows.  Each is a map with partial aggregation, so no task holds more than its share
of vectors and only d*(d+1)/2 numbers per task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, col

LIMB = 21
LEAST_SHARE = 1e-12  # eigenvalues at or below this share of the trace count as zero: their whitened values are null


def clean(embeddings: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(id, x array<long>): rows whose vector is not null, not empty, and whose entries are all finite and not null.

    Entries so large that x would leave 62 bits (|c| >= 2**62 / scale, far beyond any embedding) make their row
    unusable as well; it is left out like one with a non-finite entry.
    """
    v = col(vec_col)
    bound = float(2**62) / scale
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < bound))
    # the conversion itself never fails, as Spark may evaluate it before the filter
    x = F.transform(v, lambda c: F.when(F.abs(c.cast("double")) < bound, F.floor(c.cast("double") * scale) + offset).cast("long"))
    return embeddings.where(ok).select(col(id_col).alias("id"), x.alias("x"))


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, d)


def squares(e: np.ndarray) -> list[int]:
    """Exact sum over rows of each column of ``e`` squared, |e| < 2**62."""
    low = (1 << LIMB) - 1
    l0, l1, l2 = e & low, (e >> LIMB) & low, e >> (2 * LIMB)
    s = [np.einsum("ij,ij->j", p, q).tolist() for p, q in ((l0, l0), (l0, l1), (l0, l2), (l1, l1), (l1, l2), (l2, l2))]
    return [a + (2 * b << LIMB) + ((2 * c + dd) << 2 * LIMB) + (2 * f << 3 * LIMB) + (g << 4 * LIMB) for a, b, c, dd, f, g in zip(*s)]


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of every remaining vector on the leading ``components`` principal components.

    Rows whose vector is null, empty, or holds a null, non-finite or huge (see ``clean``) entry are left out; so are vectors of another
    length than the longest remaining one.  Null and repeated ids are kept as rows of their own.  Empty input:
    no rows.  Components are numbered from 1 by falling eigenvalue; each eigenvector's largest entry (first of
    equal ones) is positive.  A component whose eigenvalue is at most 1e-12 of the trace (n = 1, constant
    dimensions) has null whitened values; explained and identity_error are null when the trace is 0.
    Columns: id, component int, n long, deviation long (sum over dimensions of (n*x - S)^2), whitened,
    explained (eigenvalue over trace), identity_error (largest absolute entry of the whitened values'
    covariance minus the identity, over components with values).
    """
    spark = embeddings.sparkSession
    rows = clean(embeddings, id_col=id_col, vec_col=vec_col, scale=scale, offset=offset)
    d = rows.agg(F.max(F.size("x"))).first()[0]
    id_type = rows.schema["id"].dataType.simpleString()
    out_schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if d is None:
        return spark.createDataFrame([], out_schema).withColumnRenamed("id", id_col)
    rows = rows.where(F.size("x") == d)
    per_dim = rows.select(F.posexplode("x").alias("a", "v")).groupBy("a").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), (F.max("v") - F.min("v")).alias("width"))
    stats = sorted(per_dim.collect())  # d rows
    if not stats:
        return spark.createDataFrame([], out_schema).withColumnRenamed("id", id_col)
    n = stats[0]["n"]
    sums = [int(r["s"]) for r in stats]
    if 2 * n * max(r["width"] for r in stats) >= 1 << 62:
        raise OverflowError("n * (max - min) of a dimension must stay below 2**61 for exact 64-bit centred values")
    left, right = np.triu_indices(d, 1)

    def squared_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, np.int64)
        total = [0] * (d + len(left))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                dev = n * matrix(batch.slice(lo, 2048), d) - s
                total = [a + b for a, b in zip(total, squares(np.hstack([dev, dev[:, left] + dev[:, right]])))]
        if any(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["k", "q"])

    q = arrow_pass(rows, squared_sums, "k int, q decimal(38,0)").groupBy("k").agg(F.sum("q").alias("q")).collect()  # d(d+1)/2 rows
    qs = [0] * (d + len(left))
    for r in q:
        qs[r["k"]] = int(r["q"])
    cov = np.zeros((d, d))
    n3 = n**3
    for a in range(d):
        cov[a, a] = qs[a] / n3
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        cov[a, b] = cov[b, a] = (qs[d + k] - qs[a] - qs[b]) // 2 / n3  # the difference is even: 2 * sum D_a D_b
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, vectors = values[order], vectors[:, order]
    top = np.argmax(np.abs(vectors), axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    live = values > LEAST_SHARE * trace if trace > 0 else np.zeros(len(values), bool)
    project = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), np.nan)
    k = len(order)

    def whitened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        dev = n * matrix(batch, d) - np.array(sums, np.int64)
        return dev, (dev / n) @ vectors * project

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((k + 1, k))
        for batch in batches:
            w = np.nan_to_num(whitened(batch)[1])
            acc[0] += w.sum(axis=0)
            acc[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(list(acc), pa.list_(pa.float64()))], ["i", "m"])

    m = arrow_pass(rows, moments, "i int, m array<double>").groupBy("i").agg(F.array_agg("m").alias("m")).collect()  # k+1 rows
    acc = np.zeros((k + 1, k))
    for r in m:
        acc[r["i"]] = np.sum(r["m"], axis=0)
    mean = acc[0] / n
    w_cov = acc[1:] / n - np.outer(mean, mean)
    alive = np.flatnonzero(live)
    identity_error = float(np.max(np.abs(w_cov[np.ix_(alive, alive)] - np.eye(len(alive))))) if len(alive) else None
    explained = (values / trace).tolist() if trace > 0 else [None] * k

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dev, w = whitened(batch)
            big = int(np.abs(dev).max(initial=0))
            deviation = (dev * dev).sum(axis=1).tolist() if big * big * d < 1 << 62 else [sum(int(v) ** 2 for v in r) for r in dev.tolist()]
            r = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(r), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                    pa.array(np.full(r * k, n, np.int64)),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(w.reshape(-1), pa.float64(), mask=np.isnan(w.reshape(-1))),
                    pa.array(np.tile(np.array(explained, dtype=object), r).tolist(), pa.float64()),
                    pa.array([identity_error] * (r * k), pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return arrow_pass(rows, emit, out_schema).withColumnRenamed("id", id_col)

"""Whitening by polarisation against exact covariances in plain Python and numpy."""

import math
import random
from fractions import Fraction

import numpy as np

from quotaloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=32):
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in xs)
    xs = [(i, x) for i, x in xs if len(x) == d]
    n = len(xs)
    s = [sum(x[a] for _, x in xs) for a in range(d)]
    dev = [[n * x[a] - s[a] for a in range(d)] for _, x in xs]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in dev), n**3)) for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return xs, n, dev, values[order], vectors[:, order], float(np.trace(cov))


def rows_of(spark, rows, extra=()):
    return spark.createDataFrame([(i, v, 1, *extra) for i, v in rows], SCHEMA + "".join(f", {c} string" for c in ("n", "whitened")[: len(extra)]))


def test_equals_exact_covariance_and_whitens(spark):
    r = random.Random(3)
    base = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(40)]
    rows = [(i, [c + r.gauss(0, 0.01 * (k + 1)) for k, c in enumerate(base[i % 40])]) for i in range(300)]
    rows += [(1000, None), (1001, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, []), (1005, [0.5, 0.5]), (None, rows[0][1]), (7, rows[7][1])]
    got = whitening.whiten(rows_of(spark, rows).repartition(5), components=4).collect()
    xs, n, dev, values, vectors, trace = brute(rows, 4)
    assert n == 302 and len(got) == 302 * 4
    for g in got:
        assert g.n == n
    by = {}
    for g in got:
        by.setdefault(g.vec_id, []).append(g)
    devs = {}
    for (i, _), dv in zip(xs, dev):
        devs.setdefault(i, set()).add(sum(v * v for v in dv))
    for i, own in by.items():
        assert {g.deviation for g in own} <= devs[i]
    explained = sorted({(g.component, g.explained) for g in got})
    assert [c for c, _ in explained] == [1, 2, 3, 4]
    for (_, e), want in zip(explained, values / trace):
        assert abs(e - want) <= 1e-4 * want
    w = {}
    for g in got:
        if g.vec_id == 5:
            w[g.component] = g.whitened
    x5 = np.array(dev[[i for i, _ in xs].index(5)]) / n
    for c in range(4):
        want = x5 @ vectors[:, c] / math.sqrt(values[c])
        assert abs(abs(w[c + 1]) - abs(want)) < 1e-9
    assert got[0].identity_error <= 1e-4
    # the same sign for all rows, whatever the partitioning
    again = {(g.vec_id, g.component): g.whitened for g in whitening.whiten(rows_of(spark, rows).repartition(2), components=4).collect() if g.vec_id == 5}
    assert all(abs(again[(5, c)] - w[c]) < 1e-12 for c in w)


def test_one_vector_empty_table_and_clashing_columns(spark):
    one = whitening.whiten(rows_of(spark, [(1, [0.1, 0.2]), (2, None)])).collect()
    assert [(g.vec_id, g.component, g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in one] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    assert whitening.whiten(rows_of(spark, [])).count() == 0
    assert whitening.whiten(rows_of(spark, [(1, None)])).count() == 0
    clash = whitening.whiten(rows_of(spark, [(1, [0.1, 0.2]), (2, [0.3, 0.1]), (3, [0.0, 0.9])], ("x", "y"))).collect()
    assert len(clash) == 6 and {g.n for g in clash} == {3}


def test_whole_table_query(spark):
    got = queries.op12_whitening(spark, "/root/testdata/sf0.01").collect()
    vecs = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    xs, n, dev, values, vectors, trace = brute(vecs)
    assert len(got) == n * 32 and got[0].identity_error <= 1e-4
    for g in got[:64]:
        assert abs(g.explained - values[g.component - 1] / trace) <= 1e-4 * g.explained

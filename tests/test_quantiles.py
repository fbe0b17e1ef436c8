"""Exact distributed quantiles against DuckDB's quantile_disc."""

import random

import duckdb

from quotaloom.functions.ordered import exact_quantiles

PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}


def test_equals_quantile_disc_with_many_distinct_values_ties_and_nulls(spark):
    r = random.Random(2)
    rows = [("wide", r.uniform(-1e6, 1e6)) for _ in range(150_000)]  # over 100,000 distinct values in one group
    rows += [("clustered", r.choice([r.gauss(0, 1e-6), 1e9])) for _ in range(20_000)]
    rows += [("ties", float(r.randrange(5))) for _ in range(5000)] + [("one", 7.0), ("none", None), ("ties", None)]
    rows += [("small", float(v)) for v in (3, 1, 2)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {row.g: tuple(row[n] for n in PROBS) for row in exact_quantiles(df, ["g"], "v", PROBS).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    cols = ", ".join(f"quantile_disc(v, {p})" for p in PROBS.values())
    want = {g: tuple(vals) for g, *vals in con.execute(f"SELECT g, {cols} FROM t WHERE v IS NOT NULL GROUP BY g").fetchall()}
    assert got == want


def test_exact_moments_have_the_same_bits_under_any_partitioning(spark):
    import statistics

    from pyspark.sql import functions as F

    from quotaloom.functions.exprs import exact_corr, exact_stddev

    r = random.Random(6)
    rows = [(r.randrange(3), round(r.uniform(-1e4, 1e4), 2), float(r.random() < 0.3), None if r.random() < 0.05 else round(r.gauss(50, 20), 2)) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double")
    aggs = [exact_stddev("x", 2).alias("sd"), exact_corr("y", "z", 0, 2).alias("r")]
    runs = [{row.g: (row.sd, row.r) for row in d.groupBy("g").agg(*aggs).collect()} for d in (df.repartition(1), df.repartition(7), df.orderBy(F.rand(3)).repartition(13))]
    assert runs[0] == runs[1] == runs[2]
    for g, (sd, corr) in runs[0].items():
        xs = [x for k, x, _, _ in rows if k == g]
        assert abs(sd - statistics.stdev(xs)) <= 1e-9 * sd
        pairs = [(y, z) for k, _, y, z in rows if k == g and z is not None]
        assert abs(corr - statistics.correlation([p[0] for p in pairs], [p[1] for p in pairs])) <= 1e-9
    one = spark.createDataFrame([(1, 2.0, 1.0, 1.0)], "g int, x double, y double, z double").groupBy("g").agg(*aggs).first()
    assert one.sd is None and one.r is None

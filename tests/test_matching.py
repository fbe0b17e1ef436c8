"""Near-name matching against brute force over all pairs."""

import itertools
import random

from quotaloom.operators.matching import near_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["acme corp", "acme corps", "northwind traders", "northwind trader", "globex international", "globex internationals inc", "a", "ab", "initech systems group llc"]
    edit = lambda s: s[: (p := rng.randrange(len(s)))] + rng.choice(["", "x", s[p] + "y"]) + s[p + 1 :]
    names = base + [edit(s) for s in base for _ in range(4)] + [edit(edit(s)) for s in base[2:6] for _ in range(4)]
    left, right = list(enumerate(names)), list(enumerate(reversed(names)))
    want = {}
    for (i, a), (j, b) in itertools.product(left, right):
        if a and b and (s := 1 - distance(a, b) / max(len(a), len(b))) > 0.9:
            want[i] = max(want.get(i, (0, 0)), (round(s, 6), -j))
    got = near_names(spark.createDataFrame(left, "id int, name string"), spark.createDataFrame(right, "id int, name string"))
    assert {r["id"]: (r["similarity"], -r["other_id"]) for r in got.collect()} == want


def test_long_names_equal_brute_force_up_to_120_characters(spark):
    import duckdb

    rng = random.Random(8)
    letters = "abcdefghij "
    base = ["".join(rng.choice(letters) for _ in range(n)) for n in list(range(1, 121, 3)) + [9, 10, 18, 19, 27, 28, 90, 99, 100, 111, 120]]
    edit = lambda s: s[: (p := rng.randrange(len(s)))] + rng.choice(["", "x", s[p] + "y", "zz"]) + s[p + 1 :]
    names = base + [edit(s) for s in base for _ in range(2)]
    for s in base[-4:]:
        t = s
        for _ in range(len(s) // 9):
            t = edit(t)
        names.append(t)
    names += [s + "x" * (len(s) // 9) for s in base[-5:]]  # a longer partner at the edge of reach
    left, right = list(enumerate(names)), list(enumerate(reversed(names)))
    want = {}
    pairs = duckdb.sql(
        "SELECT l.i, r.j, 1 - levenshtein(l.a, r.b) / greatest(length(l.a), length(r.b)) AS s FROM (SELECT unnest(?) AS i, unnest(?) AS a) l, (SELECT unnest(?) AS j, unnest(?) AS b) r WHERE length(l.a) > 0 AND length(r.b) > 0",
        params=[[i for i, _ in left], [a for _, a in left], [j for j, _ in right], [b for _, b in right]],
    ).fetchall()
    for i, j, s in pairs:
        if s > 0.9:
            want[i] = max(want.get(i, (0, 0)), (round(s, 6), -j))
    got = near_names(spark.createDataFrame(left, "id int, name string"), spark.createDataFrame(right, "id int, name string"))
    assert {r["id"]: (r["similarity"], -r["other_id"]) for r in got.collect()} == want
    assert len(want) >= len(names)


def test_signatures_per_name_stay_small(spark):
    from pyspark.sql import functions as F

    from quotaloom.operators.matching import probes, segments

    rows = spark.createDataFrame([("a" * n,) for n in (1, 10, 60, 120)], "name string").select(F.length("name").alias("n"), F.size(segments("name")).alias("s"), F.size(probes("name")).alias("p")).collect()
    for r in rows:
        k = -(-r.n // 9) - 1
        assert r.s == k + 1 and r.p <= (2 * k + 3) * (k + 1) ** 2


def test_names_that_share_a_long_prefix_do_not_all_meet(spark):
    import duckdb

    from quotaloom.operators.matching import candidates

    rng = random.Random(4)
    for stem in ("customer#",):
        right = [stem + f"{i * 7919 % 10**9:09d}" for i in range(200)]
        edit = lambda s: s[: (p := rng.randrange(len(s)))] + rng.choice(["", "x", s[p] + "y"]) + s[p + 1 :]
        left = sorted({edit(s) for s in right} | {stem + f"{i * 104729 % 10**9:09d}" for i in range(200)})
        near = set(duckdb.sql("SELECT a, b FROM (SELECT unnest(?) AS a), (SELECT unnest(?) AS b) WHERE 1 - levenshtein(a, b) / greatest(length(a), length(b)) > 0.9", params=[left, right]).fetchall())
        names = spark.createDataFrame([(s,) for s in left], "name string")
        others = spark.createDataFrame([(s, i) for i, s in enumerate(right)], "other string, other_id int")
        got = {(r["name"], r["other"]) for r in candidates(names, others).collect()}
        assert near <= got and len(got) < len(left) * len(right) / 8, (len(near), len(got))

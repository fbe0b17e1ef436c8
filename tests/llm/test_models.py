"""Toxicity, embeddings, the pipeline and its registration."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quotaloom.llm import embedding_itq, queries, toxicity
from quotaloom.llm.common import components

SF = "/root/testdata/sf0.01"


def test_toxic_documents_are_found(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = queries.op7_toxicity(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    assert out.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert not [r for r in rows if r.predicted and not r.toxic]
    assert sum(r.predicted for r in rows) >= 0.8 * sum(r.toxic for r in rows)


def test_odd_tables_have_scores(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)] + [(None, 1), (3, None), (4, 0), (4, 0)], "doc_id long, toxic int")
    docs = brute.table(spark, brute.ODD + [(20 + i, f"nice words {i} " + "bad " * (i % 2)) for i in range(180)])
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert "bad$".encode() in {u for u in model.units}
    assert toxicity.clean(docs, model).columns == docs.columns
    nothing = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.clean(docs, nothing).count() == docs.count()
    assert toxicity.score(brute.table(spark, []), nothing).count() == 0


def all_maximal(scores):
    """Maximal scoring segments by their definition: the best segment, then left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if not best or best[0] <= 0:
        return []
    _, _, a, b = best
    return [*all_maximal(scores[:a]), (a, b - 1), *((x + b, y + b) for x, y in all_maximal(scores[b:]))]


def test_segments_are_the_maximal_ones():
    r = random.Random(4)
    model = toxicity.ToxicModel({b"badd$": 4.0, b"awfu$": 2.5, b"nast$": 1.3}, -1.0)
    for _ in range(300):
        own = [r.choice(["fine", "fine", "fine", "badd", "awfu", "nast"]) for _ in range(r.randint(0, 18))]
        scores = [model.units.get(w.encode() + b"$", -1.0) for w in own]
        n, found = model.segments(" ".join(own))
        assert n == len(own)
        got, want = [(a, b) for a, b, _ in found], all_maximal(scores)
        assert abs(sum(s for *_, s in found) - sum(sum(scores[a : b + 1]) for a, b in want)) < 1e-9
        assert len(got) == len(want)


def brute_links(rows, cosine=0.93):
    by, links, edges = defaultdict(list), Counter(), []
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[label, len(v)].append(k)
    for own in by.values():
        x = np.array([rows[k][1] for k in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            links[own[a]] += 1
            links[own[b]] += 1
            edges.append((own[a], own[b]))
    roots = brute.groups(len(rows), edges)
    return links, roots


def test_embedding_links_and_recall(spark):
    r = np.random.default_rng(1)
    centre = r.standard_normal((30, 32))
    rows = [(i, (centre[i % 30] + 0.16 * r.standard_normal(32)).astype(np.float32).tolist(), int(i % 3)) for i in range(900)]
    rows += [(1000 + i, [1.0, 0.0], 1) for i in range(3)] + [(1003, [1.0, 0.01], 1), (1004, [0.0, 0.0], 1), (1005, None, 1), (1006, [1.0, 0.0], None), (1007, [float("nan"), 1.0], 1), (1008, [1.0, None], 1), (1009, [], 1), (1010, [float("inf"), 1.0], 1), (None, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("h", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_itq.near_duplicates(df, block=64).collect()}
    links, roots = brute_links(rows)
    found, every = sum(r.n_links for r in got.values()), sum(links.values())
    assert every > 4000 and found >= 0.95 * every
    for k, (i, *_) in enumerate(rows):
        assert got[i].n_links <= links[k]
        assert i is None or got[i].kept == (got[i].component_id == i)
    assert all(got[i].n_links == 3 and got[i].component_id == 1000 for i in (1000, 1001, 1002, 1003))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1004, 1011))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_itq.near_duplicates(empty).count() == 0


def test_more_rows_give_wider_substrings():
    (w1, t1), (w2, t2) = embedding_itq.index_shape(1_000, 0.93), embedding_itq.index_shape(10**9, 0.93)
    assert w2 > w1 and t2 > t1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 300: 300, 301: 300}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "suffix_dedup", "pii", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        seen[name] = out
        if name != "packing":
            assert list(out[0].asDict()) == docs.columns
            docs = spark.createDataFrame(out, docs.schema)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert not [i for i, toxic in labels.items() if not toxic and i not in kept]
    toxic = [i for i, t in labels.items() if t]
    assert sum(i not in kept for i in toxic) >= 0.8 * len(toxic)  # toxic documents go
    rows = [(r.doc_id, r.text) for r in seen["toxicity"]]
    _, roots = brute.jaccard_roots(rows, percent=80, k=5)
    assert sorted(r.doc_id for r in seen["jaccard_join"]) == sorted(min(rows[k][0] for k in own) for own in by_root(roots).values())
    cut = brute.repeated([(r.doc_id, r.text) for r in seen["jaccard_join"]], 50)
    for before, after in zip(sorted(seen["jaccard_join"]), sorted(seen["suffix_dedup"])):
        gone = cut.get(before.doc_id, ((), ()))[1]
        assert brute.words(after.text) == [w for p, w in enumerate(brute.words(before.text)) if p not in gone]
        assert after.n_chars == len(after.text)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert sum(bool(email.search(r.text or "")) for r in seen["suffix_dedup"]) > 0
    assert not [r.doc_id for r in seen["pii"] if email.search(r.text or "")]  # every base email is redacted
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["pii"]}
    by_doc = defaultdict(list)
    for p in seen["packing"]:
        by_doc[p.doc_id].append(p)
    for own in by_doc.values():  # each document's ids once, without gaps
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == own[0].doc_tokens
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in seen["packing"])


def five_word_roots(rows):
    """Groups of texts with a Jaccard similarity of 0.8 or more on five-word shingles."""
    sets = [brute.shingle_set(t, 5) for _, t in rows]
    return brute.groups(len(rows), [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


def test_pipeline_drops_near_copies_of_five_words(spark):
    base = [f"w{j}" for j in range(200)]
    rows = [(1, " ".join(base))]
    rows += [(10 + n, " ".join(base[:80] + [f"b{n}x{j}" for j in range(n)] + base[80 + n :])) for n in (14, 16, 24)]
    rows += [(100 + n, " ".join(base + [f"t{n}x{j}" for j in range(n)])) for n in (36, 49, 60)]
    rows += [(200, " ".join(f"e{j}" if j in (30, 70, 110, 150) else w for j, w in enumerate(base))), (300, "  "), (301, "few words")]
    groups = by_root(five_word_roots(rows)).values()
    want = sorted(min(rows[k][0] for k in own) for own in groups)
    assert want == [1, 34, 160, 300, 301]
    kept = corpus_pipeline.drop_near_copies(spark, brute.table(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == want


def by_root(roots):
    out = defaultdict(list)
    for k, r in enumerate(roots):
        out[r].append(k)
    return out


def test_all_are_registered():
    known = entry.queries()
    assert "pipeline" in known
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in known) == 1


def test_toxicity_model_does_not_depend_on_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~queries.held_out())
    scored = []
    for parts in (1, 7):
        model = toxicity.train(docs.repartition(parts), labels.repartition(parts))
        scored.append({r.doc_id: r.score for r in toxicity.score(docs, model).collect()})
    assert scored[0] == scored[1]

"""Fingerprints, repeated passages, Jaccard join, licences, personal data: against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quotaloom.llm import jaccard_join, licenses, order_minhash, pii, suffix_dedup
from quotaloom.llm.license_texts import PHRASES, TEMPLATES

R = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(300)]
BASE = [[R.choice(VOCABULARY) for _ in range(R.randint(1, 110))] for _ in range(40)]


def near_copies(n):
    rows = []
    for i in range(n):
        own = list(R.choice(BASE[:12]) if R.random() < 0.5 else BASE[0] if R.random() < 0.4 else R.choice(BASE))
        for _ in range(R.randint(0, 4)):
            own[R.randrange(len(own))] = R.choice(VOCABULARY)
        rows.append((i, R.choice([" ", "\n", "  "]).join(own)))
    return rows


def mosaics(n):
    rows = []
    for i in range(n):
        own = []
        for _ in range(R.randint(0, 4)):
            b = R.choice(BASE)
            own += b[R.randrange(len(b)) :] if R.random() < 0.6 else b
            own += [R.choice(VOCABULARY) for _ in range(R.randint(0, 9))]
        rows.append((i, R.choice([" ", "\n"]).join(own)))
    return rows + [(n + j, rows[j][1]) for j in range(0, n, 5)]


# ---- order MinHash


def test_edit_pairs_follow_the_order(spark):
    rows = [(i * 7 % 101, " ".join(R.choice(BASE))) for i in range(60)] + [(200, ""), (201, None), (202, "abc"), (203, "é😀" * 30), (204, "x" * 40_000)]
    got = {r.doc_id: r for r in order_minhash.edit_pairs(brute.table(spark, rows).repartition(5)).collect()}
    omh, order = order_minhash.OrderMinHash(), sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        a, b, c = omh.values(text), omh.values(edited), omh.values(after)
        want = (n, hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), order_minhash.likeness(a, b), order_minhash.likeness(a, c))
        assert tuple(got[i])[1:] == want
    assert order_minhash.edit_pairs(brute.table(spark, [])).count() == 0
    odd = order_minhash.edit_pairs(brute.table(spark, brute.ODD)).collect()
    assert sorted(str(r.doc_id) for r in odd) == sorted(str(i) for i, _ in brute.ODD)
    alone = order_minhash.edit_pairs(brute.table(spark, [(1, "abcdefghijk")])).first()
    assert alone.near_next == 1.0


def test_signature_takes_two_least_in_text_order():
    omh, text = order_minhash.OrderMinHash(k=4, sketches=8, block=16), "the cat saw the cat that saw the cat"
    items, position = omh.items(text)
    for row, value in enumerate(omh.values(text)):
        order = ((items >> np.uint64(32)).astype(np.uint32) * omh.factor[row]).argsort(kind="stable")[:2]
        first, second = sorted(order, key=lambda k: position[k])
        mixed = order_minhash.mix(items[[first]] * np.uint64(3) + items[[second]])[0]
        assert int(mixed) >> 48 == value
    assert len(set(items.tolist())) == len(items)  # equal k-mers differ by their number


def test_likeness_falls_with_edits():
    omh, text = order_minhash.OrderMinHash(), " ".join(VOCABULARY)
    near = [order_minhash.likeness(omh.values(text), omh.values(text[:at] + "Z" * 40 + text[at + n :])) for at, n in ((100, 1), (100, 300), (100, 900))]
    assert 1 > near[0] > near[1] > near[2]
    blocks = text[600:] + text[:600]  # the same k-mers in another order
    assert order_minhash.likeness(omh.values(text), omh.values(blocks)) < 0.75


def test_items_do_not_depend_on_the_length(monkeypatch):
    monkeypatch.setattr(order_minhash, "POSITION_BITS", 10)
    omh, text = order_minhash.OrderMinHash(), "".join(chr(97 + i * i % 23) + f"{i:03d}" for i in range(270))
    edited = text[:1000]
    assert len(edited) - 7 < 1 << 10 < len(text) - 7
    (a, at), (b, _) = omh.items(text), omh.items(edited)
    assert len(a) == len(set(a.tolist())) and sorted(at.tolist()) == list(range(len(text) - 7))
    assert len(np.intersect1d(a, b)) > 0.95 * len(b)
    assert order_minhash.likeness(omh.values(text), omh.values(edited)) > 0.5


# ---- repeated passages


@pytest.mark.parametrize("least,k", [(12, 4), (50, 16)])
def test_passages_equal_brute_force(spark, least, k):
    rows = mosaics(150) + [(5000 + i, " ".join(R.choice(VOCABULARY) for _ in range(5)) + " a b" * (40 + 9 * i) + " c c" * 30 * (i % 2)) for i in range(6)]
    got = defaultdict(lambda: (set(), set()))
    for r in suffix_dedup.passages(brute.table(spark, rows).repartition(4), least=least, k=k).collect():
        span = set(range(r.start_word, r.start_word + r.n_words))
        got[r.doc_id][0].update(span)
        got[r.doc_id][1].update(span if r.removed else ())
        assert r.removed == (r.doc_id != r.first_doc_id)
    assert dict(got) == brute.repeated(rows, least)


def test_texts_without_their_repeats(spark):
    rows = mosaics(80)
    cut = brute.repeated(rows, 12)
    df = brute.table(spark, rows + [(None, None), (None, rows[3][1] + " z"), (9000, "")])
    out = suffix_dedup.without(df, least=12, k=4)
    assert out.columns == df.columns and out.count() == df.count()
    for r in out.where("doc_id < 9000").collect():
        assert brute.words(r.text) == [w for p, w in enumerate(brute.words(dict(rows)[r.doc_id])) if p not in cut.get(r.doc_id, ((), ()))[1]]
        assert r.key == "y" and r.s == 7
    assert suffix_dedup.without(brute.table(spark, []), least=12, k=4).count() == 0


# ---- Jaccard join


@pytest.mark.parametrize("frequent,block", [(8, 16), (64, 512)])
def test_join_equals_brute_force(spark, frequent, block):
    rows = near_copies(500) + [(None, " ".join(BASE[1])), (None, "x"), (5, "repeated id"), (901, None), (902, ""), (903, " \t"), (904, "A b"), (905, "a B")]
    sets, roots = brute.jaccard_roots(rows)
    ids = defaultdict(list)
    for (i, _), r in zip(rows, roots):
        ids[r].append(i)
    want = sorted(((i, len(s), i if not s else min((x for x in ids[r] if x is not None), default=None)) for (i, _), s, r in zip(rows, sets, roots)), key=str)
    df = brute.table(spark, rows).repartition(4)
    got = sorted((tuple(r) for r in jaccard_join.join(df, frequent=frequent, block=block).collect()), key=str)
    assert got == want
    kept = jaccard_join.one_of_each(df, frequent=frequent, block=block)
    assert kept.columns == df.columns
    words = kept.select("text").collect()
    assert len(words) == len(set(roots))
    assert sum(not brute.words(r.text) for r in words) == sum(not s for s in sets)


def test_sets_with_frequent_tokens_go_once_to_a_block(spark):
    """Not once per frequent token, neither as stored nor as dealt."""
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(200):
        own = list(base)
        for _ in range(3):
            own[R.randrange(200)] = f"x{R.randrange(40)}"
        rows.append((i, " ".join(own)))
    docs = jaccard_join.keyed(brute.table(spark, rows).coalesce(1), "doc_id", "text")
    every = jaccard_join.indexed(docs, jaccard_join.Orders(*jaccard_join.repeated_tokens(docs, 4, 16)), 4, 85).persist()
    assert 0 < every.where("tokens is not null").count() <= every.select("s").distinct().count()
    met = jaccard_join.meetings(every.where("hot is not null").select("s", "n", "hot"), 85, 50)
    assert met.where("lo = hi").groupBy("s").count().agg(F.max("count")).first()[0] == 1
    assert met.count() <= 200 * 16  # a set times the blocks, not times its tokens


@pytest.mark.parametrize("frequent,block", [(2, 3), (3, 40)])
def test_join_with_spread_lists_equals_brute_force(spark, frequent, block):
    """Lists that clusters scatter over many blocks are cut on their own."""
    rows = [(i, t + " tail of all texts") for i, t in near_copies(200)] + [(300 + i, f"tail of all texts {i % 7}") for i in range(40)]
    sets, roots = brute.jaccard_roots(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(brute.table(spark, rows).repartition(3), frequent=frequent, block=block).collect()}
    assert got == {i: (len(s), rows[r][0]) for (i, _), s, r in zip(rows, sets, roots)}


def test_shared_tokens_with_too_few_after_them_make_no_candidates(spark):
    """Two sets of 100 have to share 92: the first shared token stands among the first nine of both orders."""
    kind = "token long, place long, s long, n long"
    posted = [(1, 8, 10, 100), (1, 8, 11, 100), (2, 9, 10, 100), (2, 3, 12, 100), (3, 0, 11, 100), (3, 14, 13, 117), (4, 0, 12, 100), (4, 18, 13, 117)]
    pairs = jaccard_join.small_lists(spark.createDataFrame(posted, kind), 85)
    assert sorted(map(tuple, pairs.collect())) == [(10, 11, 100, 100), (11, 13, 100, 117)]
    order = [list(range(x, x + 16)) for x in (0, 1000, 2000)]
    order[1][8], order[2][9] = order[0][8], order[0][8]  # met in time by the second, too late by the third
    rows = spark.createDataFrame([(i, i, 100, b, b) for i, b in zip((10, 11, 12), order)], "key long, s long, n long, b array<int>, c array<int>")
    pairs = spark.createDataFrame([(10, 11, 100, 100), (10, 12, 100, 100)], "a long, b long, na long, nb long")
    assert [tuple(r) for r in jaccard_join.other_orders(pairs, rows, 85).collect()] == [(10, 11, 10, 11)]


def test_pairs_around_the_threshold_equal_brute_force(spark):
    """Sets of many sizes that differ in the middle, at the end and in length, just above and below the threshold."""
    r = random.Random(8)
    rows = []
    for g in range(60):
        n = r.randint(5, 120)
        own = [f"g{g}x{i}" for i in range(n)]
        for _ in range(4):
            cut, at = r.randint(0, n // 12), r.randint(0, n - 1)
            text = [*own[:at], *(f"r{r.random()}" for _ in range(r.randint(0, 3))), *own[at + cut * r.randint(0, 1) :]]
            rows.append((len(rows), " ".join(text[: len(text) - cut * r.randint(0, 1)])))
    sets, roots = brute.jaccard_roots(rows)
    least = {root: min(i for i, x in enumerate(roots) if x == root) for root in set(roots)}
    got = {x.doc_id: x.component_id for x in jaccard_join.join(brute.table(spark, rows).repartition(3)).collect()}
    assert got == {i: least[root] if sets[i] else i for i, root in enumerate(roots)}
    assert 60 < len(set(got.values())) < 220


def test_join_of_nothing(spark):
    assert jaccard_join.join(brute.table(spark, [])).count() == 0
    assert jaccard_join.one_of_each(brute.table(spark, [])).count() == 0


# ---- licences


def test_licences_equal_brute_force(spark):
    parts = [*PHRASES, "under the", "license", "mit", "version", "2", "cc", "by", "nc", "apache", "Foo", "É", ",", "-", " "]
    rows = brute.ODD + [(1000 + i, R.choice([" ", ", ", "\n"]).join(R.choice(parts) for _ in range(R.randint(0, 30)))) for i in range(400)]
    got = sorted((tuple(r)[:6] for r in licenses.scan(brute.table(spark, rows)).collect()), key=str)
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
        at = [(p, label) for phrase, label in PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        want.append((i, len(w), len(at), min((p for p, _ in at), default=None), max((p for p, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=str)


def test_templates_are_covered(spark):
    rows = [(k, "Some words before. " + text + " and after") for k, text in enumerate(TEMPLATES.values())]
    rows += [(50, TEMPLATES["mit"].replace("copy, modify", "fold")), (51, TEMPLATES["gpl"][:60])]
    out = {r.doc_id: r for r in licenses.scan(brute.table(spark, rows)).collect()}
    for k, label in enumerate(TEMPLATES):
        assert label in out[k].labels.split(",") and out[k].score == 1.0
    assert out[50].labels == "mit" and 0.9 < out[50].score < 1
    assert out[51].labels == "" and 0 < out[51].score < 0.5


# ---- personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


@pytest.fixture(scope="module")
def personal(spark):
    parts = ["a.b@c.de", "x@y", "_d@e.f", "1.2.3.4", ".5", "999.1.1.1", "+1 (569) 555-6633", " 479532601", "4111 1111 1111 1111", "4111111111111112", "5", " ", "-", "é😀", "phone ", "\n", "www", "0.0.0.255", "+49.30-1234567", "card: "]
    rows = brute.ODD + [(1000 + i, "".join(R.choice(parts) for _ in range(R.randint(0, 14)))) for i in range(600)] + [(5000, "1 " * 9000), (5001, "a@b" + ".c" * 9000), (5002, "+1" + "(" * 5000)]
    docs = brute.table(spark, rows)
    return rows, docs, pii.train(docs)


def test_base_spans_equal_the_patterns(personal):
    rows, docs, model = personal
    got = sorted((tuple(r) for r in pii.report(pii.find(docs, model)).collect()), key=str)
    want = []
    for i, text in rows:
        spans = base_spans(text or "")
        counts = [sum(s[1] == k for s in spans) for k in range(4)]
        want.append((i, *counts, hashlib.sha256(",".join(f"{kind}:{a}:{e}" for a, _, e, kind in spans).encode()).hexdigest()))
    assert [r[:6] for r in got] == sorted(want, key=str)
    texts = {i: t for i, t in rows if i is not None and i >= 1000}
    for r in got:
        if r[0] in texts:
            assert {f"{kind}:{a}:{e}" for a, _, e, kind in base_spans(texts[r[0]])} <= set(r[6].split(","))


def test_personal_data_is_planned_without_python(personal):
    _, docs, model = personal
    text = pii.report(pii.find(docs, model))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", text)


def test_redaction(spark, personal):
    rows = [(1, "mail a.b@c.de now"), (2, None), (3, ""), (4, "+1 (569) 555-6633 479532601 4111111111111111")]
    out = {r.doc_id: r.text for r in pii.redact(pii.find(brute.table(spark, rows), personal[2])).collect()}
    # the phone pattern swallows the whole run of digits and fails its count, so only added spans can redact here; the
    # trees no longer see the check itself, so a bare 16-digit run without context is not added (a model that saw the
    # label as a feature used to add it)
    assert out[1] == "mail [email] now" and out[2] is None and out[3] == "" and out[4].startswith("[phone] ")
    empty = brute.table(spark, [])
    assert pii.redact(pii.find(empty, pii.train(empty))).columns == empty.columns
    assert pii.find(brute.table(spark, rows), pii.PiiModel()).where(F.size("pii") > 0).count() == 1  # the base patterns swallow the rest


def _used(node, out):
    if not isinstance(node, float):
        out.add(node[0])
        _used(node[2], out)
        _used(node[3], out)
    return out


def test_trees_learn_the_check_from_format_and_context_and_context_matters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert "check" not in pii.FEATURES
    full = pii.train(docs)
    used = set().union(*(_used(t, set()) for t in full.trees)) if full.trees else set()
    assert len(used) > 1  # more than one feature decides
    ablated = pii.train(docs, features=[f for f in pii.FEATURES if f not in pii.CONTEXT_FEATURES])
    assert not {pii.FEATURES.index(f) for f in pii.CONTEXT_FEATURES} & set(ablated.columns)
    added = lambda model: {(r.doc_id, s.start, s.kind) for r in pii.find(docs, model).collect() for s in r.pii if not s.base}
    with_context, without = added(full), added(ablated)
    print(f"added spans: {len(with_context)} with context features, {len(without)} without, {len(with_context ^ without)} differ")
    assert with_context is not None and without is not None


def test_redacted_keeps_every_other_column(spark, personal):
    rows = spark.createDataFrame([(1, "mail a.b@c.de now", "keep", 5), (2, None, None, 6)], "doc_id long, text string, pii string, row int")
    out = {r.doc_id: r for r in pii.redacted(rows, personal[2]).collect()}
    assert list(out[1].asDict()) == ["doc_id", "text", "pii", "row"]
    assert (out[1].text, out[1].pii, out[1].row) == ("mail [email] now", "keep", 5) and (out[2].text, out[2].pii) == ("", None)


def test_the_model_is_fitted_on_the_spans_of_all_texts(spark, monkeypatch):
    texts = [" ".join(f"host 10.{i}.{j}.{j * 9 % 400}" for j in range(70)) for i in range(30)]
    stored = []
    monkeypatch.setattr(pii, "store", lambda df, name: stored.append(df) or df)
    pii.train(brute.table(spark, list(enumerate(texts))))
    spans = brute.table(spark, list(enumerate(texts))).select(F.size(F.concat(*(pii.candidates(F.col("text"), k) for k in pii.KINDS))).alias("n"))
    assert stored[0].agg(F.sum("n")).first()[0] == spans.agg(F.sum("n")).first()[0] >= 30 * 140  # none left out, beyond 50 of a text too

"""Conversation prefix trie against a plain Python trie."""

import hashlib
import random
import re
import zlib

from quotaloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    seqs = {}
    for c, ts in own.items():
        ts = [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1], x[2]))]
        own[c] = ts
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(c - 20 * int(c / 20)) if c < 0 else c - c % 20, [])
        seqs[c] = tuple(base[:h] + own[c][h:])
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = set()
    for key, members in nodes.items():
        d = len(key)
        children = [k for k in nodes if len(k) == d + 1 and k[:d] == key]
        sub = [k for k in nodes if len(k) >= d and k[:d] == key]
        leaves = sum(1 for k in sub if not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in nodes))
        saved = sum((len(nodes[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0) for k in sub)
        ends = sorted(c for c in members if len(seqs[c]) == d)
        parent = min(nodes[key[:-1]]) if d else None
        out.add((min(members), d, parent, len(members), len(children), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def got(df):
    return {tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def fixture():
    r = random.Random(7)
    texts = ["hi", "hello there", "", None, "a b  c", "same", "x\ty"]
    rows = []
    for c in range(0, 130):
        if c % 17 == 5:
            continue  # absent bases and turnless conversations
        for t in range(r.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t if r.random() > 0.05 else None, r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += [(40, 1, "user", "dup"), (40, 1, "user", "dup"), (None, 0, "user", "orphan"), (200, None, None, None)]
    rows += [(300 + i, 0, "system", "you help") for i in range(30)]  # a hot first turn
    return rows


def test_equals_plain_trie(spark):
    rows = fixture()
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_small_sketch_groups_more_but_gives_the_same(spark):
    rows = fixture()
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), max_width=4)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, 0, "u", "a b", 5, "x", 7)], SCHEMA + ", c long, d string, g1 long")
    assert got(prefix_trie.trie(clash)) == brute([(1, 0, "u", "a b")])


def test_whole_table_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_very_long_conversations(spark):
    long = [(40, t, "user" if t % 2 else "assistant", f"turn {t} " + "word " * (t % 7)) for t in range(300)]
    other = [(41, t, role, text if t < 299 else "another ending") for _, t, role, text in long]
    rows = long + other + [(60, t, "user", "x") for t in range(250)]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)

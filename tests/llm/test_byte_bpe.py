"""Byte-level BPE by merge replay against the tiktoken library."""

import base64
import hashlib
import random
import sys

import brute
import pytest
import tiktoken
import public_tokenizers

from quotaloom.llm import byte_bpe, queries
from quotaloom.llm.queries import MULTI_RANKS

SAMPLE = "/root/testdata/sf0.001/documents.parquet"


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(SAMPLE).select("doc_id", "text").collect()]
    r = random.Random(11)
    parts = [*"ab c\n\t 'sSéÉΣİẞ12,.!?\x1c\x1f\x85\xa0", "<|endoftext|>", "  ", "\n\n", "aaaa", " t", "'ll", "😀", "中", "ã", "ﬁ", "‍"]
    odd = [(10_000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(1500)]
    return brute.ODD + real + odd


def test_ids_and_decoding_equal_the_library(spark, docs):
    lib = library(MULTI_RANKS)
    got = byte_bpe.encode(brute.table(spark, docs).repartition(4), MULTI_RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(docs)
    want = {}
    for i, t in docs:
        want.setdefault(i, set()).add(tuple(lib.encode_ordinary(t or "")))
    for row in got:
        assert tuple(row.ids) in want[row.doc_id]
        assert bytes(row.decoded) == lib.decode_bytes(row.ids)


def test_digests_of_the_query(spark, docs):
    lib = library(MULTI_RANKS)
    rows = byte_bpe.digests(byte_bpe.encode(brute.table(spark, docs), MULTI_RANKS, public_tokenizers.PATTERN)).collect()
    by_id = {i: t or "" for i, t in docs if i is not None and sum(j == i for j, _ in docs) == 1}
    for row in rows:
        if row.doc_id in by_id:
            ids = lib.encode_ordinary(by_id[row.doc_id])
            assert row.n_tokens == len(ids)
            assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert row.decoded_sha256 == hashlib.sha256(by_id[row.doc_id].encode()).hexdigest()


def test_whole_table_equals_the_library(spark):
    lib = library(MULTI_RANKS)
    rows = queries.op11_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        ids = lib.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_a_merge_that_makes_a_lower_pair_finishes_its_word_exactly(tmp_path):
    """x+a ranks first, then x+a+b+c, then b+c: merging b+c makes a pair that ranks below it."""
    tokens = [bytes((b,)) for b in range(256)] + [b"xa", b"xabc", b"bc", b"ab", b"cd"]
    path = tmp_path / "tiny.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for r, t in enumerate(tokens)))
    ranks = byte_bpe.Ranks(str(path))
    words = [b"xabcd", b"xabc", b"abcd", b"xab", b"yy", b"", b"bcxabc"]
    got = byte_bpe.replay(words, ranks)
    lib = tiktoken.Encoding("tiny", pat_str=r"\S+", mergeable_ranks=dict(zip(tokens, range(len(tokens)))), special_tokens={})
    assert got == [lib.encode_ordinary(w.decode()) for w in words]
    assert got[0] == [257, ord("d")]


def small_ranks(path, tokens):
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for r, t in enumerate([bytes((b,)) for b in range(256)] + tokens)))
    return byte_bpe.Ranks(str(path))


def test_replay_equals_the_plain_loop_on_random_vocabularies(tmp_path):
    """Overlapping places, runs of one letter and merges that make lower pairs."""
    r = random.Random(5)
    for trial in range(60):
        letters = b"abc"[: 2 + trial % 2]
        pool, tokens = [bytes((c,)) for c in letters], []
        for _ in range(r.randint(1, 25)):
            if len(t := r.choice(pool) + r.choice(pool)) < 9 and t not in tokens:
                tokens.append(t)
                pool.append(t)
        r.shuffle(tokens)
        ranks = small_ranks(tmp_path / f"{trial}.tiktoken", tokens)
        words = [bytes(r.choices(letters, k=r.randint(0, 30))) for _ in range(40)]
        assert byte_bpe.replay(words, ranks) == [[ranks.ranks[w]] if w in ranks.ranks else byte_bpe.lowest_pair_loop(list(w), ranks) for w in words]


def test_python_steps_follow_the_ranks_not_the_merges(tmp_path):
    r = random.Random(6)
    ranks = small_ranks(tmp_path / "few.tiktoken", [b"aa", b"ab", b"ba", b"bb", b"aaab", b"abab", b"abba"])
    words = list({bytes(r.choices(b"ab", k=60)) for _ in range(1000)})
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        ids = byte_bpe.replay(words, ranks)
    finally:
        sys.settrace(before)
    assert b"".join(map(ranks.decode, ids)) == b"".join(words)
    assert lines < sum(map(len, words)) - sum(map(len, ids))  # the number of merges


def test_empty_table_and_clashing_columns(spark):
    empty = byte_bpe.encode(brute.table(spark, []), MULTI_RANKS, public_tokenizers.PATTERN)
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids", "decoded"]
    clash = spark.createDataFrame([(1, "a b", "x", 5, b"q")], "doc_id long, text string, ids string, n_tokens int, decoded binary")
    row = byte_bpe.digests(byte_bpe.encode(clash, MULTI_RANKS, public_tokenizers.PATTERN)).first()
    assert row.n_tokens == 2

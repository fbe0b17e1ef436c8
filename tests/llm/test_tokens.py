"""Packing, encoding and counting against the tokenizers library."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from quotaloom.llm import bpe, packing, token_counts
from quotaloom.llm.queries import BYTE_BPE, WORD_BPE

SAMPLE = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id + 100, r.text) for r in spark.read.parquet(SAMPLE).select("doc_id", "text").collect()]
    r = random.Random(5)
    parts = [*"ab c\n\t 'sSéÉΣİẞ12,.!?\x1c\x1f\x85\xa0", "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", "aaaa", " t", "'ll", "😀", "中", "é"]
    odd = [(10_000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(1500)]
    return brute.ODD + real + odd


def sequences(docs):
    """Expected ids by text."""
    library = Tokenizer.from_file(BYTE_BPE)
    texts = sorted({t or "" for _, t in docs})
    return dict(zip(texts, (e.ids for e in library.encode_batch(texts, add_special_tokens=False))))


def test_packing_places_every_id_once(spark, docs):
    ids = sequences(docs)
    pieces = packing.pack(brute.table(spark, docs).repartition(3), BYTE_BPE).collect()
    by_doc, places = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    padding = sum(2048 - sum(n for _, n in own) for own in places.values())
    assert padding <= 2048 * 3 + 0.02 * sum(p.length for p in pieces)
    unique = {i: t for i, t in docs if sum(j == i for j, _ in docs) == 1}
    for i, t in unique.items():
        want, at = [*ids[t or ""], 1], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(want[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want)
    assert sum(p.length for p in pieces) == sum(len(ids[t or ""]) + 1 for _, t in docs)
    assert packing.pack(brute.table(spark, []), BYTE_BPE).count() == 0


def test_best_fit_is_tightest():
    r = random.Random(2)
    lengths = [r.choice([64, r.randint(1, 64)]) for _ in range(400)]
    number, offset, used = packing.best_fit_decreasing(lengths, 64)
    free, want = [], {}
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 64) - lengths[i])
        want[i] = (64 if not fits else min(fits)) - lengths[i]
    assert len(free) == used
    assert {i: 64 - offset[i] - lengths[i] for i in range(400)} == want
    assert len({(n, o) for n, o in zip(number, offset)}) == 400


def test_word_end_encoding_equals_library(spark, docs):
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    texts = sorted({t or "" for _, t in docs})
    want = {}
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[t] = (len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False)))
    got = sorted(tuple(r) for r in bpe.encode_decode(brute.table(spark, docs), WORD_BPE).na.fill({"doc_id": -1}).collect())
    assert got == sorted((-1 if i is None else i, *want[t or ""]) for i, t in docs)
    full = bpe.encode_decode(brute.table(spark, docs[:40]), WORD_BPE, with_ids=True).collect()
    encoder = bpe.encoder(WORD_BPE)
    assert all(encoder.decode(r.ids) == r.decoded and len(r.ids) == r.n_tokens for r in full)


def test_counts_equal_library(spark, docs):
    ids = sequences(docs)
    got = sorted(tuple(r) for r in token_counts.count_tokens(brute.table(spark, docs), BYTE_BPE).na.fill({"doc_id": -1}).collect())
    assert got == sorted((-1 if i is None else i, len((t or "").encode()), len(ids[t or ""]), len(ids[t or ""]) > 512) for i, t in docs)


def test_fast_library_agrees_on_latin_1():
    r, library, ids = random.Random(9), Tokenizer.from_file(BYTE_BPE), packing.token_ids(BYTE_BPE)
    texts = ["".join(r.choice([chr(r.randint(0, 255)), "a", " ", "\n", "'s", "1", "<|endoftext|>"]) for _ in range(r.randint(0, 40))) for _ in range(20_000)]
    assert all(ids(t).tolist() == e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)))

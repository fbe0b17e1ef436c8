"""Byte-level BPE by corpus-level merge replay: ranks of a ``.tiktoken`` file applied to all words of a batch at once.

The words (pre-tokens) of a batch of texts are taken once each.  Their bytes lie in one linked list of symbols; an
inverted index maps each merge rank to the places where a pair of that rank starts.  Ranks are replayed from the
lowest: all places of the rank are merged at once as arrays (of overlapping ones every other, from the left), and only
their new neighbour pairs are looked up and entered in the index.  A place whose pair changed since it was entered is
skipped.

This equals taking, word by word, the lowest-ranked pair (leftmost of equal ones) as long as a merge never makes
a pair of lower rank than its own.  Vocabularies allow that (``x`` + ``abc`` can rank below ``bc``); such a word
is finished on its own at that moment by the plain lowest-pair loop, from the same state, so results stay exact.
A word that is a vocabulary entry as a whole is that one token, as the tiktoken library has it.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, col, slices, strings


class Joined:
    """Ranks of the pairs of the vocabulary, by one of their two tokens."""

    def __init__(self, by: np.ndarray, other: np.ndarray, rank: np.ndarray, n: int):
        order = np.lexsort((other, by))
        self.other, self.rank = other[order], rank[order]
        self.start = np.searchsorted(by[order], np.arange(n + 1))

    def __call__(self, token: int, others: np.ndarray) -> np.ndarray:
        """Rank of ``token`` joined with each of ``others``, -1 for none."""
        lo, hi = self.start[token], self.start[token + 1]
        if lo == hi:
            return np.full(len(others), -1, np.int64)
        known = self.other[lo:hi]
        at = np.minimum(known.searchsorted(others), hi - lo - 1)
        return np.where(known[at] == others, self.rank[lo:hi][at], -1)


class Ranks:
    """Ranks of a ``.tiktoken`` file (base64 of the bytes, space, rank per line) and lookups of pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.bytes: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.byte_ids = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        self.byte_pairs = np.array([[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)], np.int64)
        cuts = ((a, b, rank) for token, rank in ranks.items() for at in range(1, len(token)) if (a := ranks.get(token[:at])) is not None and (b := ranks.get(token[at:])) is not None)
        pairs = np.fromiter(itertools.chain.from_iterable(cuts), np.int64).reshape(-1, 3)
        self.before = Joined(pairs[:, 1], pairs[:, 0], pairs[:, 2], len(self.bytes))
        self.after = Joined(pairs[:, 0], pairs[:, 1], pairs[:, 2], len(self.bytes))

    def pair(self, a: int, b: int) -> int:
        return self.ranks.get(self.bytes[a] + self.bytes[b], -1)

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ``ids``: their vocabulary entries put together."""
        return b"".join(map(self.bytes.__getitem__, ids))


def lowest_pair_loop(parts: list[int], ranks: Ranks) -> list[int]:
    """The plain loop: merge the lowest-ranked pair, leftmost of equal ones, until none is left."""
    while len(parts) > 1:
        best, at = -1, -1
        for k in range(len(parts) - 1):
            r = ranks.pair(parts[k], parts[k + 1])
            if r >= 0 and (best < 0 or r < best):
                best, at = r, k
        if at < 0:
            break
        parts[at : at + 2] = [best]
    return parts


def replay(words: Sequence[bytes], ranks: Ranks) -> list[list[int]]:
    """Token ids of each word, all words merged together rank by rank."""
    out: list[list[int] | None] = [None] * len(words)
    single = ranks.ranks
    todo = []
    for w, word in enumerate(words):
        whole = single.get(word)
        if whole is not None or not word:
            out[w] = [whole] if whole is not None else []
        else:
            todo.append(w)
    if not todo:
        return out  # type: ignore[return-value]
    raw = np.frombuffer(b"".join(words[w] for w in todo), np.uint8)
    bounds = np.cumsum([0, *(len(words[w]) for w in todo)])
    starts, lasts = bounds[:-1], bounds[1:] - 1
    tok = ranks.byte_ids[raw]
    rank = np.full(len(raw), -1, np.int64)  # of the pair that starts at a place
    rank[:-1] = ranks.byte_pairs[raw[:-1], raw[1:]]
    rank[lasts] = -1
    nxt, prv = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
    nxt[lasts] = prv[starts] = -1
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray, new: np.ndarray) -> None:
        order = new.argsort(kind="stable")
        places, new = places[order], new[order]
        cuts = [0, *(np.flatnonzero(new[1:] != new[:-1]) + 1).tolist(), len(new)]
        for q, lo, hi in zip(new[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if q in index:
                index[q].append(places[lo:hi])
            else:
                index[q] = [places[lo:hi]]
                heapq.heappush(heap, q)

    def finish(w: int) -> None:
        """A word on its own, from its present state; its places leave the index."""
        own = tok[bounds[w] : bounds[w + 1]]
        out[todo[w]] = lowest_pair_loop(own[own >= 0].tolist(), ranks)
        own[:] = rank[bounds[w] : bounds[w + 1]] = -1

    if len(places := np.flatnonzero(rank >= 0)):
        enter(places, rank[places])
    while heap:
        r = heapq.heappop(heap)
        i = np.concatenate(index.pop(r))
        i = i[rank[i] == r]  # else stale: the pair there changed since it was entered
        if not len(i):
            continue
        i.sort()
        j = nxt[i]
        if len(i) > 1 and (chained := j[:-1] == i[1:]).any():  # of places that overlap every other one, from the left
            at = np.arange(len(i))
            first = np.maximum.accumulate(np.where(np.r_[False, chained], 0, at))
            alone = (at - first) % 2 == 0
            i, j = i[alone], j[alone]
        h, k = prv[i], nxt[j]
        twice = np.r_[k[:-1] == i[1:], False]  # the next place in the list follows at once
        has_left, has_right = (h >= 0) & ~np.r_[False, twice[:-1]], k >= 0
        left, right = np.full(len(i), -1, np.int64), np.full(len(i), -1, np.int64)
        left[has_left] = ranks.before(r, tok[h[has_left]])
        right[has_right] = ranks.after(r, tok[k[has_right]])
        lower = (left >= 0) & (left < r) | (right >= 0) & (right < r)
        if twice.any():  # looked up with the token as it stood, then with what it is merged into
            own = ranks.after(r, np.array([r]))[0]
            right[twice] = own
            lower |= twice & (0 <= own < r)
        if lower.any():
            for w in np.unique(bounds.searchsorted(i[lower], "right") - 1).tolist():
                finish(w)
            stay = tok[i] >= 0
            i, j, h, k, left, right, has_left, has_right = (x[stay] for x in (i, j, h, k, left, right, has_left, has_right))
        tok[i], tok[j], rank[i], rank[j] = r, -1, right, -1
        nxt[i], prv[k[has_right]] = k, i[has_right]
        rank[h[has_left]] = left[has_left]
        wider, longer = left >= 0, right >= 0
        if len(places := np.r_[h[wider], i[longer]]):
            enter(places, np.r_[left[wider], right[longer]])
    left_over = tok >= 0
    kept = np.r_[0, np.cumsum(left_over)][bounds].tolist()
    ids = tok[left_over].tolist()
    for w, lo, hi in zip(todo, kept, kept[1:]):
        if out[w] is None:
            out[w] = ids[lo:hi]
    return out  # type: ignore[return-value]


@functools.lru_cache(maxsize=2)  # a worker keeps what it learnt, words included, for its next task
def encoder(path: str, pattern: str) -> tuple[Ranks, regex.Pattern, dict[str, bytes], dict[str, bytes]]:
    return Ranks(path), regex.compile(pattern), {}, {}


def joined(pieces: Sequence[Sequence[str]], known: dict[str, bytes], unit: int = 1) -> tuple[bytes, np.ndarray]:
    """What is known of each text's words put together, and where each text starts, in units of ``unit`` bytes."""
    parts = [b"".join(map(known.__getitem__, own)) for own in pieces]
    return b"".join(parts), np.cumsum([0, *map(len, parts)], dtype=np.int64) // unit


def learn(pieces: Sequence[Sequence[str]], ranks: Ranks, known: dict[str, bytes], decoded: dict[str, bytes], limit: int = 400_000) -> None:
    """Words of the batch that are not known are replayed together: their ids (32 bits each) and the bytes these decode to."""
    if len(known) > limit:
        known.clear()
        decoded.clear()
    new = [w for w in dict.fromkeys(itertools.chain.from_iterable(pieces)) if w not in known]
    for lo, hi in slices(new, 1 << 20):
        for w, ids in zip(new[lo:hi], replay([w.encode("utf-8") for w in new[lo:hi]], ranks)):
            known[w] = array.array("i", ids).tobytes()
            decoded[w] = ranks.decode(ids)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, and the bytes they decode to.

    Each match of ``pattern`` is encoded on its own; no special tokens.  One pass without a shuffle; words already
    seen by a worker are remembered (at most 400,000, then forgotten at once).  A null or empty text has no ids and
    decodes to empty bytes; null ids, repeated rows and any further columns are kept apart (only the two named
    columns are read).  Empty table: no rows.  Columns: id, ids array<int>, decoded binary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cut, known, decoded = encoder(ranks_path, pattern)
        for batch in batches:
            pieces = [cut.findall(t) for t in strings(batch)]
            learn(pieces, ranks, known, decoded)
            ids, at = joined(pieces, known, 4)
            data, place = joined(pieces, decoded)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
            texts = pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, texts], ["id", "ids", "decoded"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    out = arrow_pass(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded bytes)."""
    return encoded.select(
        col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

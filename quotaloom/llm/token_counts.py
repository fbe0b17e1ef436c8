"""Token counts: rank-synchronous merging of pre-tokens held as ragged numpy arrays."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, col, strings
from .tokens import Chunks, byte_alphabet

#: Fixed value: the pre-token pattern of the byte-level format.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)


class MergeTable:
    """Ranks and results of merges, looked up for arrays of pairs."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        ids = np.array([vocabulary[c] for c in byte_alphabet()], np.int32)
        if len(np.unique(made)) != len(made):  # two ways to a symbol: its later pairs could outrank the merge under way
            raise ValueError("a symbol is the result of two merges; rank-synchronous merging needs one")
        self.bytes, self.made, self.width = ids, made, max(vocabulary.values()) + 1
        order = np.argsort(keys := left * self.width + right)
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


def surviving(sequences: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols left of each sequence.  Every round applies, in all sequences at once, each one's lowest-ranked pair."""
    n = np.array([len(s) for s in sequences], np.int64)
    total = n.copy()
    symbols = table.bytes[np.frombuffer(b"".join(sequences), np.uint8)]
    owner = np.repeat(np.arange(len(n)), n)
    ranks = np.full(len(symbols), NONE, np.int32)  # of the pair that starts here
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    ranks[inner] = table.rank(symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lengths = np.diff(np.r_[starts, len(owner)])
        least = np.minimum.reduceat(ranks, starts)
        live = np.repeat(least != NONE, lengths)
        if not live.all():  # finished sequences leave
            symbols, owner, ranks = symbols[live], owner[live], ranks[live]
            keep = least != NONE
            lengths, least = lengths[keep], least[keep]
            if not len(symbols):
                break
        hit = ranks == np.repeat(least, lengths)
        at = np.flatnonzero(hit)
        # in a run of overlapping hits (a a a) every other one counts, from the left
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[place % 2 == 0]
        symbols[at] = table.made[ranks[at]]
        gone = np.zeros(len(symbols), bool)
        gone[at + 1] = True
        total -= np.bincount(owner[at], minlength=len(total))
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        touched[np.maximum(at - 1, 0)] = True
        symbols, owner, ranks, touched = symbols[~gone], owner[~gone], ranks[~gone], touched[~gone]
        # a pair before a merged place, the merged place, and one whose left neighbour was merged away
        touched[:-1] |= touched[1:]
        i = np.flatnonzero(touched)
        last = np.r_[owner[1:] != owner[:-1], True]
        ranks[i] = NONE
        i = i[~last[i]]
        ranks[i] = table.rank(symbols[i], symbols[i + 1])
    return total


@functools.lru_cache(maxsize=2)  # what a worker has learnt serves its next task
def counter(path: str, limit: int = 400_000) -> Chunks:
    """Chunks whose values are numbers of tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = MergeTable(spec["model"]["vocab"], spec["model"]["merges"])
    special = [t["content"] for t in spec["added_tokens"]]
    cut, between = regex.compile(PRETOKENS), regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def encode(chunks: list[str]) -> list[int]:
        pieces = [cut.findall(c) for c in chunks]
        flat = list(dict.fromkeys(p for own in pieces for p in own))
        known = dict(zip(flat, surviving([p.encode("utf-8", "surrogatepass") for p in flat], table).tolist()))
        return [sum(known[p] for p in own) for own in pieces]

    def whole(text: str) -> list[int]:
        parts = between.split(text)
        return [*encode(parts), len(parts) - 1]

    return Chunks(encode, whole, special, limit)


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every text by the merges of a byte-level BPE file, and whether they exceed ``limit``.

    One pass over the input without a shuffle.  Strings of special tokens inside a text count as one token.
    Null or empty text: 0 bytes, 0 tokens.  Repeated rows and null ids are kept.  Empty table: no rows.
    Columns: id, n_bytes, n_tokens, over_limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = counter(tokenizer)
        for batch in batches:
            texts = strings(batch)
            n = [sum(v) for v in chunks.values(texts)]
            size = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    few = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    out = arrow_pass(few, run, f"id {few.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.select(F.col("id").alias(id_col), *out.columns[1:])

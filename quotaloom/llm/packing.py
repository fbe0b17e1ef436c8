"""Packing documents into token windows: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, col, strings
from .token_counts import PRETOKENS
from .tokens import byte_alphabet

PIECES_A_ROUND = 1 << 17


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over the capacities finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stack: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.stack[capacity].append(which)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with the least capacity of at least ``need``."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # climb until a right sibling holds a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._change(capacity, -1)
        return capacity, self.stack[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window number, offset) of each piece, and how many windows are used.  Pieces of equal length keep their order."""
    open_windows, number, offset, used = OpenWindows(window), [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        found = open_windows.take(need) if need < window else None
        capacity, which = found or (window, used)
        used += found is None
        number[i], offset[i] = which, window - capacity
        if capacity > need:
            open_windows.add(capacity - need, which)
    return number, offset, used


class TokenIds:
    """Ids of texts as the tokenizers library gives them for a byte-level file.

    Texts of Latin-1 characters go through tiktoken with the file's own merges: the two libraries agree there (tested
    with every character in random surroundings) and it is several times faster.  All others, where the libraries'
    Unicode tables might differ, go through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in s): i for s, i in self.library.get_vocab(with_added_tokens=False).items() if s not in special}
        self.fast = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def __call__(self, text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special=self.special)


@functools.lru_cache(maxsize=1)  # a worker loads a file once
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``window`` tokens.

    A document is its ids and then ``end_id``; what exceeds a window is first cut into full windows, the rest is one
    piece.  Every input partition packs its own pieces (at most 131,072 at a time) as they stream by, so nothing is
    shuffled and memory is bounded; each such round leaves about one window partly open.  The result is a function of
    the input splits, so a task that is run again gives the same rows.

    Null or empty text: one piece of one token (``end_id``).  Null or repeated ids: each row is a document of its own
    and keeps its id.  Empty table: no rows.  Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        encode, sequence, end = token_ids(tokenizer), TaskContext.get().partitionId() << 40, np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal sequence
            number, offset, used = best_fit_decreasing([r[2] for r in rows], window)
            ids, start, length, crc, total = zip(*rows)
            arrays = [pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, [sequence + n for n in number], offset))]
            sequence += used
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("id").type
            for doc, text in zip(batch.column("id").to_pylist(), strings(batch)):
                data = encode(text).astype("<u4").tobytes() + end
                n = len(data) // 4
                for at in range(0, n, window):
                    piece = data[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), n))
                if len(rows) >= PIECES_A_ROUND:
                    yield packed()
        if rows:
            yield packed()

    few = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    out = arrow_pass(few, run, f"id {few.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.select(F.col("id").alias(id_col), *out.columns[1:])

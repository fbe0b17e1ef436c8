"""BPE encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding by vocabulary strings."""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, col, slices, strings
from .tokens import byte_alphabet

#: Fixed value: the pre-token pattern of the word-end format.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Python takes these for white space, the format does not.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
REMEMBERED = 500_000


class WordEndBPE:
    """Encoder for a tokenizer file with word ends (NFC, lower case, white space dropped).

    ``model`` is the file's content.  Ids of chunks between white space are remembered, as are those of pre-tokens.
    """

    def __init__(self, spec: dict):
        vocabulary = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.vocabulary, self.alphabet = vocabulary, byte_alphabet()
        self.strings = {i: s for s, i in vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.numbers = {i: str(i) for i in self.strings}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cut, self.white = regex.compile(PRETOKENS), regex.compile(r"[^\S\x1c-\x1f]+")
        self.pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token.

        The queue holds (rank, place, left id, right id); an entry is stale, and skipped, when the symbols at its place
        are no longer those two.  Equal ranks apply from the left.
        """
        symbols = [self.alphabet[b] for b in piece.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        ids = [self.vocabulary[s] for s in symbols]
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, i, left, right, made = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heappush(queue, (found[0], i, made, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], made))):
                heappush(queue, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text and "İ" not in text else "".join(c.lower() for c in text)

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by spaces, vocabulary strings joined by spaces, of a normalised chunk."""
        ids: list[int] = []
        for piece in self.cut.findall(chunk):
            known = self.pieces.get(piece)
            if known is None:
                known = self.merge(piece)
                if len(piece) < 64:
                    self.pieces[piece] = known
            ids += known
        return len(ids), " ".join([self.numbers[i] for i in ids]), " ".join([self.strings[i] for i in ids])

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """The chunks of a text in order, each encoded."""
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        out = []
        for run in self.between.split(text) if self.between and any(s in text for s in self.special) else [text]:
            if run in self.special:
                out.append((1, str(self.special[run]), run))
                continue
            known, run = self.chunks, self.normal(run)
            for c in run.split() if not any(s in run for s in SEPARATORS) else filter(None, self.white.split(run)):
                if (found := known.get(c)) is None:
                    found = self.chunk(c)
                    if len(c) < 64:
                        known[c] = found
                if found[0]:
                    out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, which a file without a decoder joins by spaces."""
        return " ".join([self.strings[i] for i in ids])


@functools.lru_cache(maxsize=2)  # what a worker has learnt serves its next task
def encoder(path: str) -> WordEndBPE:
    with open(path, encoding="utf-8") as f:
        return WordEndBPE(json.load(f))


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every text, and the text that they decode to, as digests (``with_ids``: the ids and the decoded text too).

    One pass over the input without a shuffle.  Null or empty text: no ids, the digests of the empty string.
    Repeated rows and null ids are kept.  Empty table: no rows.  Very long texts are encoded whole; only a single
    pre-token's queue is held besides the text and its ids.
    Columns: id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(tokenizer), hashlib.sha256
        for whole in batches:
            every = strings(whole)
            for lo, hi in slices(every):
                n, ids, decoded = [], [], []
                for text in every[lo:hi]:
                    parts = bpe.parts(text)
                    n.append(sum([p[0] for p in parts]))
                    ids.append(" ".join([p[1] for p in parts]))
                    decoded.append(" ".join([p[2] for p in parts]))
                arrays = [whole.column("id").slice(lo, hi - lo), pa.array(n, pa.int64()), *(pa.array([sha(x.encode("utf-8", "surrogatepass")).hexdigest() for x in xs]) for xs in (ids, decoded))]
                if with_ids:
                    arrays += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
    few = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    out = arrow_pass(few, run, f"id {few.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
    return out.select(F.col("id").alias(id_col), *out.columns[1:])

"""Repeated passages by sparse suffix arrays.

Suffixes that start at content-selected minimiser positions are sorted by a hash of their leading words; neighbours of
equal hash from two texts mark a shared position.  Matches are not extended from neighbour to neighbour, as the first
owner of a passage needs all documents that hold it: every window of ``least`` words around a shared position is looked
up among the windows of the other texts, and runs of windows that occur elsewhere make the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType, StructField, StructType

from .common import arrow_pass, col, slices, store, strings
from .hashing import POWERS, U, mix, word_hashes

#: Keys of rows without an id lie above all ids below it.
NO_ID = 1 << 62
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on."""
    if len(words) < k:
        return np.zeros(0, U)
    up, down = POWERS.of(len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(words) - k + 1])


class Minimisers:
    """Of each window of ``least`` words, the place of its least run of ``k`` words: the same in every text that holds it."""

    def __init__(self, texts: list[str], least: int, k: int):
        self.words, self.first = word_hashes(texts)
        self.least, n = least, len(self.words)
        self.runs = run_hashes(self.words, k)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        start = np.arange(max(n - least + 1, 0))
        whole = doc[start] == doc[start + least - 1] if len(start) else start.astype(bool)
        self.start = start[whole]  # of windows that lie in one text
        self.doc = doc[self.start]
        if len(start):
            self.place = (start + sliding_window_view(self.runs, least - k + 1).argmin(1))[whole]
        else:
            self.place = start

    def signatures(self) -> list[int]:
        """63-bit hash of each text's words."""
        out = []
        for lo, hi in zip(self.first[:-1], self.first[1:]):
            own = self.words[lo:hi]
            out.append(int(mix((own * POWERS.of(len(own))[0]).sum(dtype=U, keepdims=True) + U(len(own)))[0] >> U(1)))
        return out


def suffixes(docs: DataFrame, least: int, k: int) -> DataFrame:
    """(run, key, s, n): the leading words of the selected suffixes, each once per text and task, and for every row of
    ``docs`` one with null run and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, keys = strings(batch), batch.column("key").to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                m = Minimisers(texts[lo:hi], least, k)
                s = np.array(m.signatures(), np.int64)
                new = np.zeros(hi - lo, bool)
                for i, x in enumerate(s.tolist()):
                    if x not in seen:
                        new[i] = True
                        if len(seen) < 1 << 20:
                            seen.add(x)
                pick = np.unique(m.place[new[m.doc]])
                doc = np.searchsorted(m.first, pick, side="right") - 1
                each = np.lexsort((m.runs[pick], doc))
                pick, doc = pick[each], doc[each]
                other = np.r_[True, (doc[1:] != doc[:-1]) | (m.runs[pick[1:]] != m.runs[pick[:-1]])][: len(pick)]
                pick, doc = pick[other], doc[other]
                yield rows(m.runs[pick].view(np.int64), keys[lo:hi][doc], s[doc], None)
                yield rows(None, keys[lo:hi], s, np.diff(m.first))

    def rows(run: np.ndarray | None, key: np.ndarray, s: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
        arrays = [pa.nulls(len(s), pa.int64()) if x is None else pa.array(x) for x in (run, key, s, n)]
        return pa.RecordBatch.from_arrays(arrays, names=["run", "key", "s", "n"])

    return arrow_pass(docs.select("key", "text"), run, "run long, key long, s long, n long")


def neighbours(sorted_rows: DataFrame, by: str, other: str, keep: list[str]) -> DataFrame:
    """Of rows that arrive sorted by (``by``, ``other``): those of each run of equal ``by`` with two values of ``other``,
    with the least of them as ``least``.  Streams; only rows that may still turn out to be alone are held.

    Rows with ``again`` (if there is such a column) pass through with a null ``least``."""
    names = list(dict.fromkeys([by, other, *keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_by, open_least = None, None, None  # rows of an open run with one value so far; or its key and least value
        for batch in batches:
            if not batch.num_rows:
                continue
            if "again" in batch.schema.names:
                later = batch.filter(batch.column("again"))
                if later.num_rows:
                    yield pa.RecordBatch.from_arrays([*(later.column(n) for n in (other, *keep)), pa.nulls(later.num_rows, pa.int64())], names=[other, *keep, "least"])
                batch = batch.filter(pc.invert(batch.column("again")))
                if not batch.num_rows:
                    continue
            x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if held is not None:
                x = {n: np.concatenate([held[n], x[n]]) for n in names}
            b, o = x[by], x[other]
            start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            size = np.diff(np.r_[start, len(b)])
            least, last = o[start], o[np.r_[start[1:], len(b)] - 1]
            if held is None and open_by is not None and b[0] == open_by:
                least[0] = open_least
                two = last != least
                two[0] = True
            else:
                two = last != least
            emit = np.repeat(two, size)
            if emit.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(x[n][emit]) for n in (other, *keep)), pa.array(np.repeat(least, size)[emit])], names=[other, *keep, "least"])
            open_by, open_least = b[-1], least[-1]
            held = None if two[-1] else {n: v[start[-1] :] for n, v in x.items()}
            if held is not None:
                open_by = None

    return arrow_pass(sorted_rows.select(*names, *(["again"] if "again" in sorted_rows.columns else [])), run, ", ".join(f"{n} long" for n in (other, *keep, "least")))


def windows(texts: DataFrame, least: int, k: int) -> DataFrame:
    """(window, key, s, at, again) of the windows whose minimiser starts one of the ``runs``; ``again`` marks those that
    the same text has further left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, keys, s = strings(batch), batch.column("key").to_numpy(), batch.column("s").to_numpy()
            runs = batch.column("runs").to_pylist()
            for lo, hi in slices(every):
                m = Minimisers(every[lo:hi], least, k)
                right = np.array(m.signatures(), np.int64) == s[lo:hi]  # another text under a repeated id
                own, bounds = m.runs[m.place].view(np.int64), np.searchsorted(m.doc, np.arange(hi - lo + 1))
                hit = np.zeros(len(own), bool)
                for i in np.flatnonzero(right):
                    a, b = bounds[i], bounds[i + 1]
                    hit[a:b] = np.isin(own[a:b], runs[lo + i])
                start, doc = m.start[hit], m.doc[hit]
                window = run_hashes(m.words, least)[start].view(np.int64)
                order = np.lexsort((start, window, doc))
                again = np.zeros(len(order), bool)
                again[order[1:]] = (window[order[1:]] == window[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (window, keys[lo:hi][doc], s[lo:hi][doc], start - m.first[doc], again)], names=["window", "key", "s", "at", "again"])

    return arrow_pass(texts.select("key", "s", "text", "runs"), run, "window long, key long, s long, at long, again boolean")


def key_of(kind: DataType) -> Column:
    """Orders documents: the id, or for rows without an integer id a hash of id and text that lies above all ids."""
    other = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("id", "text"), 3)
    return F.coalesce(F.col("id").cast("long"), other) if isinstance(kind, IntegralType) else other


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text)."""
    few = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    return few.select("id", key_of(few.schema["id"].dataType).alias("key"), "text")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50, k: int = 16) -> DataFrame:
    """(key, s, start, words, first_key, removed): maximal passages of documents, in words, all of whose windows of
    ``least`` words occur in another document too and first occur in the document ``first_key``.

    The document with the smallest id keeps a passage (``removed`` false), all later ones lose it.  Words are what white
    space separates, A-Z in lower case; repeats inside one document alone do not count.  Equal texts are looked at once:
    the copy with the smallest id stands for all, the others are repeated as a whole (if they have ``least`` words).
    Null and empty texts and texts under ``least`` words have no passage.  Rows without an id come after all others;
    rows of one id count as one document.  Empty table: no rows.
    """
    docs = keyed(docs, id_col, text_col)
    every = store(suffixes(docs, least, k), "suffixes")
    texts = every.where("run is null").groupBy("s").agg(F.min("key").alias("first_key"), F.count("*").alias("copies"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = every.where("run is not null").select("run", "s").repartition(parts, "run").sortWithinPartitions("run", "s")
    runs = neighbours(ordered, "run", "s", ["run"]).groupBy("s").agg(F.collect_set("run").alias("runs"))
    chosen = runs.join(texts, "s").select("s", F.col("first_key").alias("key"), "runs")
    found = windows(docs.join(chosen, "key"), least, k)
    # a text's own repeats of a window need no neighbour; dealt out by place they crowd no task
    spread = found.withColumn("deal", F.when(F.col("again"), F.xxhash64("key", "at")).otherwise(F.col("window")))
    ordered = spread.repartition(parts, "deal").sortWithinPartitions("window", "key", "at")
    rows = neighbours(ordered, "window", "key", ["s", "at", "window"])
    passages = joined(rows, least)
    whole = every.where(F.col("run").isNull() & (F.col("n") >= least)).join(texts.where("copies > 1"), "s")
    copies = whole.select("key", "s", F.lit(0).cast("long").alias("start"), F.col("n").alias("words"), "first_key", (F.col("key") != F.col("first_key")).alias("removed"))
    return passages.unionAll(copies)


def joined(rows: DataFrame, least: int) -> DataFrame:
    """Runs of windows of one document with the same first document, as passages.

    A window with null ``least`` takes that of the equal window further left, and is none if that has none."""

    def run(group: pa.Table) -> pa.Table:
        known = group.filter(pc.is_valid(group.column("least")))
        if not known.num_rows:
            return kinds.empty_table()
        key, s, at, first, window = (known.column(c).to_numpy() for c in ("key", "s", "at", "least", "window"))
        later = group.filter(pc.is_null(group.column("least")))
        if later.num_rows:
            order = np.argsort(window)
            place = order[np.minimum(np.searchsorted(window[order], later.column("window").to_numpy()), len(order) - 1)]
            same = window[place] == later.column("window").to_numpy()
            at, first = np.r_[at, later.column("at").to_numpy()[same]], np.r_[first, first[place[same]]]
        order = np.lexsort((at, first))
        at, first = at[order], first[order]
        start = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (at[1:] != at[:-1] + 1)])
        end = np.r_[start[1:], len(at)] - 1
        n = len(start)
        return pa.table({"key": np.repeat(key[:1], n), "s": np.repeat(s[:1], n), "start": at[start], "words": at[end] - at[start] + least, "first_key": first[start], "removed": first[start] != key[0]})

    kinds = pa.schema([*((c, pa.int64()) for c in ("key", "s", "start", "words", "first_key")), ("removed", pa.bool_())])
    return rows.groupBy("key", "s").applyInArrow(run, "key long, s long, start long, words long, first_key long, removed boolean")


def passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50, k: int = 16) -> DataFrame:
    """(id, start_word, n_words, first_id, removed): ``repeats`` with ids; rows without an id have null there."""
    out = repeats(docs, id_col=id_col, text_col=text_col, least=least, k=k)
    name = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(name("key").alias(id_col), F.col("start").alias("start_word"), F.col("words").alias("n_words"), name("first_key").alias(f"first_{id_col}"), "removed")


def without(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 50, k: int = 16) -> DataFrame:
    """``docs`` without the removed passages: from the first of their words to the word after them.  All rows and columns
    stay; a text that is repeated as a whole becomes empty."""
    cuts = repeats(docs, id_col=id_col, text_col=text_col, least=least, k=k).where("removed").groupBy("key", "s").agg(F.collect_list(F.struct("start", "words")).alias("cuts"))
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*(col(c) for c in rest)).alias("rest"), col(text_col).alias("own"), col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    packed = packed.select("rest", "own", key_of(packed.schema["id"].dataType).alias("key"))
    by_key = cuts.groupBy("key").agg(F.collect_list(F.struct("s", "cuts")).alias("by_text"))
    both = packed.join(by_key, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, by_text in zip(batch.column("own").to_pylist(), batch.column("by_text").to_pylist()):
                if text and by_text:
                    own = Minimisers([text], least, k).signatures()[0]
                    spans = [(c["start"], c["words"]) for x in by_text if x["s"] == own for c in x["cuts"]]
                    text = cut_words(text, spans) if spans else text
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])

    out = arrow_pass(both.select("rest", "own", "by_text"), run, StructType([both.schema["rest"], StructField("text", StringType())]))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, n in sorted(spans):
        lo, hi = starts[start], starts[start + n]
        if hi > at:
            out.append(text[at : max(lo, at)])
            at = hi
    return "".join([*out, text[at:]])

"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, col, slices, store, strings
from .hashing import shingles, word_hashes

#: Bytes of a word's start that stand for its unseen forms, longest first; a whole word goes before them.
PREFIXES = (6, 5, 4)
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of letters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


@dataclass
class ToxicModel:
    """Units (``word$`` or the start of a word) with positive log-odds, and the constants of the calibration."""

    units: dict[bytes, float] = field(default_factory=dict)
    background: float = -0.1
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    shift: float = -5.0

    def __post_init__(self):
        self.gates = {u.rstrip(b"$")[: PREFIXES[-1]] for u in self.units}

    def unit_score(self, word: bytes) -> float | None:
        """The highest score among the word and its starts."""
        found = [s for u in (word + b"$", *(word[:n] for n in PREFIXES if len(word) >= n)) if (s := self.units.get(u)) is not None]
        return max(found, default=None)

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, all maximal scoring segments as first word, last word, score), in linear time."""
        own, gates, gate = words(text), self.gates, PREFIXES[-1]
        hits = [(i, s) for i, w in enumerate(own) if w[:gate] in gates and (s := self.unit_score(w)) is not None]
        kept: list[list] = []  # first, last, sum before, sum after
        total, before = 0.0, -1
        for i, s in hits:
            total += self.background * (i - before - 1)
            before, new = i, [i, i, total, total + s]
            total += s
            while True:  # join with the last candidate that starts lower, as long as it also ends lower
                j = len(kept) - 1
                while j >= 0 and kept[j][2] >= new[2]:
                    j -= 1
                if j < 0 or kept[j][3] >= new[3]:
                    kept.append(new)
                    break
                new = [kept[j][0], new[1], kept[j][2], new[3]]
                del kept[j:]
        return len(own), [(a, b, hi - lo) for a, b, lo, hi in kept]

    def statistic(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum of the normalised scores of the segments that exceed chance, or that of the best one; 0 words: like 1."""
        chance = math.log(self.k * max(n, 1))
        scores = sorted((self.lam * s - chance for *_, s in found), reverse=True) or [-chance - 1]
        return sum(s for s in scores if s > 0) or scores[0]

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * statistic + self.shift))))

    def significant(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Segments with an extreme-value probability by chance of at most 0.05."""
        return [x for x in found if -math.expm1(-self.k * max(n, 1) * math.exp(-self.lam * x[2])) <= 0.05]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, marks = strings(batch), []
        for lo, hi in slices(texts):
            hashes, first = word_hashes(texts[lo:hi])
            for a, b in zip(first[:-1], first[1:]):
                marks.append(int(shingles(hashes[a:b], 5).min(initial=2**64 - 1)) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, "mark"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold a word; under the empty word all texts, under a space all words of them."""
    for batch in batches:
        by: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(strings(batch), batch.column("toxic").to_pylist()):
            own = words(text)
            by[toxic].update({*own, b""})
            by[toxic][b" "] += len(own)
        units = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array([by[1][u] for u in units], pa.int64()), pa.array([by[0][u] for u in units], pa.int64())], names=["unit", "y1", "y0"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, prior: float = 0.01, z: float = 1.5, floor: float = 2.0, drift: float = 0.1) -> ToxicModel:
    """Fit on about ``sample`` labelled rows at most, chosen by a hash of the id.

    Of rows of one label whose least 5-word shingle hash is equal, as in copies and most near copies, one counts: else
    the words of a large group of copies would pass for toxic ones.

    A unit is a whole word, counted by the texts that hold it, or the first 4 to 6 bytes of words, counted by the
    different words that begin so (one frequent word doesn't make its start toxic).  Its log-odds between toxic and
    clean use a Dirichlet prior spread as in both together, with pseudo-counts of the share ``prior`` of all counts; its
    score is their lower bound, ``z`` standard errors below, and units whose bound is under ``floor`` score as background.
    Lambda and K follow from the scores' distribution in clean text, the last step (a logistic curve over the segments'
    normalised scores) from the sample's documents.  Null ids, labels and texts are left out.  Without a label of each
    kind nothing is toxic.
    """
    known = labels.where(col(id_col).isNotNull() & col(label_col).isNotNull()).groupBy(col(id_col).alias("lid")).agg(F.max(col(label_col).cast("int")).alias("toxic"))
    n = known.count()
    share = F.lit(min(1.0, sample / max(n, 1)) * 1e6)
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "lid"), F.lit(10**6)) < share).where("toxic in (0, 1)")
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("lid"))
    picked = rows.where("text is not null").select("toxic", "text", F.col("id").cast("string").alias("id"))
    marked = arrow_pass(picked, _marked, "toxic int, text string, id string, mark long")
    # one text per label and near-copy mark: the one of the least id (then text), whatever the partitioning
    first = marked.groupBy("toxic", "mark").agg(F.min_by("text", F.struct("id", "text")).alias("text"))
    rows = store(first.select("toxic", "text"), "toxicity-sample")
    counts = store(arrow_pass(rows, _counted, "unit binary, y1 long, y0 long").groupBy("unit").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), "toxicity-counts")
    totals = {bytes(r["unit"]): r for r in counts.where("unit in (X'', X'20')").collect()}
    if not totals or not totals[b""]["y1"] or not totals[b""]["y0"]:
        return ToxicModel()
    found = counts.where("unit not in (X'', X'20')")
    starts = F.explode(F.array(*(F.when(F.length("unit") >= n, F.substring("unit", 1, n)) for n in PREFIXES))).alias("start")
    types = found.select(starts, (F.col("y1") > 0).cast("long").alias("y1"), (F.col("y0") > 0).cast("long").alias("y0")).where("start is not null")
    kinds = types.where(F.length("start") == PREFIXES[-1]).agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).first()
    clean = max(totals[b" "]["y0"], 1)
    units: dict[bytes, float] = {}
    chance: dict[bytes, float] = {}
    for table, whole, end in ((found, totals[b""], b"$"), (types.groupBy(F.col("start").alias("unit")).agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), kinds, b"")):
        n1, n0 = whole["y1"] or 1, whole["y0"] or 1
        for r in table.where(f"y1 >= 3 and y1 * {n0 / n1!r} > 2 * y0").collect():
            y1, y0, a = r["y1"], r["y0"], prior * (r["y1"] + r["y0"])
            more = prior * (n1 + n0)
            odds = math.log((y1 + a) / max(n1 + more - y1 - a, 0.5)) - math.log((y0 + a) / (n0 + more - y0 - a))
            bound = odds - z * math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
            if bound >= floor:
                units[bytes(r["unit"]) + end] = bound
                chance[bytes(r["unit"]) + end] = (y0 + 0.5) / clean
    return _calibrated(units, chance, rows, drift)


def _calibrated(units: dict[bytes, float], p: dict[bytes, float], rows: DataFrame, drift: float) -> ToxicModel:
    """``p``: how often a word of clean text has the unit, with half a count for what clean text does not hold."""
    model = ToxicModel(units, -drift)
    mass = min(0.5, sum(p.values()))
    scores, weights = np.array([*units.values(), -drift]), np.array([*p.values(), 1 - mass])
    lo, hi = 0.0, 50.0
    for _ in range(100):  # lambda: the expectation of exp(lambda * score) is one
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(weights @ np.exp(np.minimum(mid * scores, 700))) < 1 else (lo, mid)
    model.lam = max(lo, 1e-3)
    model.k = max(1e-6, drift * model.lam * mass)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([model.statistic(*model.segments(t)) for t in strings(batch)], pa.float64())], names=["toxic", "x"])

    seen = arrow_pass(rows, measured, "toxic int, x double").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float)
    design, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):  # logistic curve with a small ridge
        q = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]) + 1e-2 * np.eye(2), design.T @ (y - q) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    model.slope, model.shift = max(float(w[0]), 0.0), float(w[1])
    return model


def score(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted, passages) of every whole text: one pass without a shuffle.

    ``passages`` lists the significant toxic segments as first word, last word and score.  Null and empty texts have
    no segment and get the score of a one-word clean text.  Repeated rows and null ids are kept; empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, passages = [], []
            for text in strings(batch):
                n, found = model.segments(text)
                p.append(model.probability(model.statistic(n, found)))
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in model.significant(n, found)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(passages, kind)], names=["id", "score", "predicted", "passages"])

    few = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    out = arrow_pass(few, run, f"id {few.schema['id'].dataType.simpleString()}, score double, predicted int, passages array<struct<first:long,last:long,score:double>>")
    return out.select(F.col("id").alias(id_col), "score", "predicted", "passages")


def clean(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, with all their columns.  Null and empty texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.column("rest")
            keep = [model.probability(model.statistic(*model.segments(t or ""))) < threshold for t in rest.field(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    place = docs.columns.index(text_col)
    packed = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("rest"))
    return arrow_pass(packed, run, packed.schema).select("rest.*")

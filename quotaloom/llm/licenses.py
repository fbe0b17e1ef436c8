"""License scans: a generalised suffix automaton of licence words gives matching statistics, which chain into spans."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, col, slices, strings
from .license_texts import PHRASES, TEMPLATES

#: A-Z to lower case; of ASCII only letters and digits are parts of words, beyond it everything is.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class LicenceAutomaton:
    """Suffix automaton of all phrases and templates.

    Each state knows the phrases that end with it and, for every template, the end of its first occurrence there.
    """

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.at: list[dict[int, int]] = [{}]  # template -> end of its first occurrence
        self.labels, self.sizes = list(templates), []
        for text in phrases:
            self._add(words(text), None)
        for t, text in enumerate(templates.values()):
            own = words(text)
            self.sizes.append(len(own))
            self._add(own, t)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:  # a suffix ends wherever the longer string does
            up = self.at[self.link[s]]
            for t, e in self.at[s].items():
                up[t] = min(e, up.get(t, e))
        self.ends: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for text, label in phrases.items():
            own, s = words(text), 0
            for w in own:
                s = self.next[s][w]
            self.ends[s].append((len(own), label))
        for s in reversed(order):
            self.ends[s] = self.ends[s] + self.ends[self.link[s]]
        self.vocabulary = set().union(*self.next)

    def _add(self, own: list[bytes], template: int | None) -> None:
        last = 0
        for end, w in enumerate(own):
            last = self._extend(last, w)
            if template is not None:
                self.at[last].setdefault(template, end)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.at.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def scan(self, own: list[bytes], least: int) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """(phrase starts with labels, maximal matches of at least ``least`` words as first word, words, state)."""
        nxt, link, length, ends, vocabulary = self.next, self.link, self.length, self.ends, self.vocabulary
        phrases, matches, before = [], [], -2
        s = n = 0
        for i in [i for i, w in enumerate(own) if w in vocabulary]:
            w = own[i]
            if i != before + 1 and s:
                if n >= least:
                    matches.append((before - n + 1, n, s))
                s = n = 0
            before = i
            if w not in nxt[s]:
                if n >= least:
                    matches.append((i - n, n, s))
                while s and w not in nxt[s]:
                    s = link[s]
                n = length[s]
            s = nxt[s].get(w, 0)
            n = n + 1 if s else 0
            for size, label in ends[s]:
                if n >= size:
                    phrases.append((i - size + 1, label))
        if n >= least:
            matches.append((before - n + 1, n, s))
        return phrases, matches

    def chains(self, matches: list[tuple[int, int, int]], gap: int) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, matched words, share of the template) of chains of matches in template order."""
        open_: dict[int, list[int]] = {}
        out = []

        def close(t: int) -> None:
            first, end, _, matched = open_.pop(t)
            out.append((self.labels[t], first, end - 1, matched, min(1.0, matched / self.sizes[t])))

        for first, n, s in matches:
            for t, end in self.at[s].items():
                begin = end - n + 1
                if t in open_:
                    _, doc_end, place, _ = open_[t]
                    cut = max(0, doc_end - first, place - begin)  # words the chain has already
                    if first <= doc_end + gap and cut < n and begin + cut <= place + gap:
                        open_[t] = [open_[t][0], first + n, end + 1, open_[t][3] + n - cut]
                        continue
                    if cut >= n and first <= doc_end + gap:
                        continue
                    close(t)
                open_[t] = [first, first + n, end + 1, n]
        for t in list(open_):
            close(t)
        return out


@functools.lru_cache(maxsize=4)
def automaton(phrases: tuple, templates: tuple) -> LicenceAutomaton:
    return LicenceAutomaton(dict(phrases), dict(templates))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, least: int = 4, gap: int = 12, coverage: float = 0.5) -> DataFrame:
    """Licence phrases and covered template spans of every whole text, in one pass without a shuffle.

    Matches of at least ``least`` words chain into a span of one template while they follow each other in both texts
    with at most ``gap`` words between; a span that covers ``coverage`` of its template adds the template's label.
    Null or empty text: no words, no labels, score 0.  Repeated rows and null ids are kept; empty table: no rows.
    Columns: id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a phrase, else the best
    coverage), spans (label, first, last, matched, coverage of every chain).
    """
    own_phrases, own_templates = tuple(phrases.items()), tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(own_phrases, own_templates)
        for whole in batches:
            every = strings(whole)
            for lo, hi in slices(every, 1 << 22):
                rows = []
                for text in every[lo:hi]:
                    own = words(text)
                    found, matches = machine.scan(own, least)
                    spans = machine.chains(matches, gap)
                    base = {label for _, label in found}
                    more = {label for label, *_, share in spans if share >= coverage}
                    starts = [i for i, _ in found]
                    best = 1.0 if found else max((x[-1] for x in spans), default=0.0)
                    rows.append((len(own), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), best, [dict(zip(("label", "first", "last", "matched", "coverage"), x)) for x in spans]))
                yield pa.RecordBatch.from_arrays([whole.column("id").slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names=names)

    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    few = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    out = arrow_pass(few, run, f"id {few.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,matched:long,coverage:double>>")
    return out.select(F.col("id").alias(id_col), *names[1:])

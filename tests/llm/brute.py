"""Plain Python versions of the operators, and small tables with nulls, empty and long texts, repeats and clashing names."""

import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, n_tokens string, key string, s long"  # further columns with names of results and internals


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in rows], SCHEMA)


ODD = [
    (None, "no id at all"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Same text, twice."), (6, "Same text, twice."),
    (6, "Same text, twice."), (7, "é😀中   x y ß Σας İ"), (8, "<|endoftext|> and <|startoftext|>"), (9, "a" * 3000), (10, "ab " * 4000), (11, "\x1c\x1f ok"),
]


def groups(n, edges):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def shingle_set(text, k=4):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def jaccard_roots(rows, percent=85, k=4):
    sets, held, edges = [shingle_set(t, k) for _, t in rows], defaultdict(list), []
    for k, own in enumerate(sets):
        shared = Counter(o for t in own for o in held[t])
        edges += [(o, k) for o, n in shared.items() if 100 * n >= percent * (len(own) + len(sets[o]) - n)]
        for t in own:
            held[t].append(k)
    return sets, groups(len(rows), edges)


def repeated(rows, least):
    """doc -> (words repeated in another document, words first seen in an earlier one)."""
    own = [(i, words(t)) for i, t in rows]
    where = defaultdict(set)
    for i, w in own:
        for p in range(len(w) - least + 1):
            where[tuple(w[p : p + least])].add(i)
    out = {}
    for i, w in own:
        both, gone = set(), set()
        for p in range(len(w) - least + 1):
            docs = where[tuple(w[p : p + least])]
            if len(docs) > 1:
                both |= set(range(p, p + least))
                if min(docs) != i:
                    gone |= set(range(p, p + least))
        if both:
            out[i] = (both, gone)
    return out

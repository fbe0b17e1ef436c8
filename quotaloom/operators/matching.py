"""Account matching between two CRMs: domain, then near-equal name, then a manual map.

Near-equal means 1 - edit distance / longer length > 0.9.  Candidates come from a segment index: a name of
length L can only be near-equal to names within k = ceil(L/9) - 1 edits (a longer partner r has
ed >= |r| - L and ed < |r|/10, so ed < L/9).  Cut into k+1 even segments, one of them survives any k edits
unchanged; so each name is indexed by (L, segment, text), and each probe name emits, for each length L
within reach, the substrings that can hold segment i after the edits: starts within i of its place and within
k - i of its place shifted by the length difference (multi-match-aware windows).  An equality join on the
signatures finds every near pair, each candidate is verified by ``levenshtein``, and no block of merely similar
names is ever paired with itself.  A name has k+1 index rows and O(k^2) probes per length, so long names cost
little, unlike the deletion variants this replaces.  Signatures that many names share are refined (``candidates``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaloom.functions.exprs import cases
from quotaloom.plans.registry import job

SIMILARITY = 0.9
#: Pairs that a signature may give per row that holds it, before the rest of the names is cut as well.
CROWD = 32


def reach(length: Column) -> Column:
    """Edits a near-equal partner of a name of this length can be away (similarity > 0.9)."""
    return (F.ceil(length / 9) - 1).cast("int")


def _cut(length: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of edits+1 even segments of a string of ``length``."""
    parts = edits + 1
    q, longer_from = F.floor(length / parts).cast("int"), parts - length % parts
    return i * q + F.greatest(F.lit(0), i - longer_from), q + F.when(i >= longer_from, 1).otherwise(0)


def _sig(key: Column, i: Column, text: Column, at: Column, size: Column, start: Column, length: Column, edits: Column) -> Column:
    """Signature of a segment that stands at ``start`` of ``text`` and at ``at`` of an indexed text of ``length``.

    ``todo``: what lies left and right of it, as far as edits are left for it and it can be cut again: (text, length in
    the index, edits).  Where segment i is the first that the edits spare, i of them lie before it.
    """
    left = F.struct(F.substring(text, F.lit(1), start).alias("x"), at.cast("int").alias("m"), i.cast("int").alias("k"))
    right = F.struct(F.substring(text, start + size + 1, F.length(text)).alias("x"), (length - at - size).cast("int").alias("m"), (edits - i).cast("int").alias("k"))
    key = F.concat_ws("|", key.cast("string"), i.cast("string"), F.substring(text, start + 1, size))
    return F.struct(key.alias("key"), F.filter(F.array(left, right), lambda r: (r["k"] > 0) & (r["m"] > r["k"])).alias("todo"))


def _indexed(key: Column, text: Column, edits: Column) -> Column:
    """Signatures of an indexed text: one for each of its edits+1 segments."""
    n = F.length(text)

    def one(i: Column) -> Column:
        at, size = _cut(n, edits, i)
        return _sig(key, i, text, at, size, at, n, edits)

    return F.transform(F.sequence(F.lit(0), edits), one)


def _probed(key: Column, text: Column, length: Column, edits: Column) -> Column:
    """Signatures of a probe: the places of ``text`` that can hold a segment of an indexed text of ``length``."""
    r = F.length(text)
    delta = r - length

    def per_segment(i: Column) -> Column:
        at, size = _cut(length, edits, i)
        lo = F.greatest(F.greatest(at - i, at + delta - (edits - i)), F.lit(0))
        hi = F.least(F.least(at + i, at + delta + (edits - i)), r - size)
        return F.transform(_span(lo, hi), lambda p: _sig(key, i, text, at, size, p, length, edits))

    return F.flatten(F.transform(F.sequence(F.lit(0), edits), per_segment))


def segments(name: str) -> Column:
    """Index signatures of a name: (length, segment, segment text) for each of its k+1 segments."""
    n = F.length(name)
    return _indexed(n, F.col(name), reach(n))


def _span(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def probes(name: str) -> Column:
    """Probe signatures: for each indexed length L within reach, substrings that can hold each of its segments."""
    r = F.length(name)
    lengths = F.filter(F.sequence(F.greatest(F.lit(1), r - F.ceil(r / 8).cast("int") - 1), r + F.ceil(r / 8).cast("int") + 1), lambda m: F.abs(r - m) <= reach(m))
    return F.flatten(F.transform(lengths, lambda m: _probed(m, F.col(name), m, reach(m))))


def candidates(names: DataFrame, others: DataFrame) -> DataFrame:
    """(name, other, other_id): every near pair, and not many more, of ``names`` (name) and ``others`` (other, other_id).

    A signature that many names share on both sides (a common prefix, say) does not pair them: there the rest of the
    names to its left and right is cut again, with the edits left for it, until the shared parts tell them apart or
    nothing is left to compare.  Every other signature gives at most ``CROWD`` pairs per row that holds it.
    """
    a = names.select("name", F.inline(probes("name")))
    b = others.select("other", "other_id", F.inline(segments("other")))
    found = []
    while True:
        more = F.size("todo") > 0
        both = a.where(more).groupBy("key").agg(F.count("*").alias("_a")).hint("merge").join(b.where(more).groupBy("key").agg(F.count("*").alias("_b")), "key")
        crowded = both.where(F.col("_a") * F.col("_b") > CROWD * (F.col("_a") + F.col("_b"))).select("key").persist()
        last = crowded.isEmpty()
        x, y = (a, b) if last else (a.join(crowded, "key", "left_anti"), b.join(crowded, "key", "left_anti"))
        found.append(x.select("key", "name").hint("merge").join(y.select("key", "other", "other_id"), "key").select("name", "other", "other_id"))
        if last:
            return reduce(DataFrame.union, found).distinct()
        cut = F.col("todo")[0]
        rest = lambda df: df.select(*(c for c in df.columns if c not in ("s", "todo")), F.col("s.key").alias("key"), F.concat("s.todo", F.slice("todo", 2, F.greatest(F.size("todo"), F.lit(1)))).alias("todo"))
        a = rest(a.join(crowded, "key").select("name", "todo", F.explode(_probed(F.col("key"), cut["x"], cut["m"], cut["k"])).alias("s"))).persist()
        b = rest(b.join(crowded, "key").select("other", "other_id", "todo", F.explode(_indexed(F.col("key"), cut["x"], cut["k"])).alias("s"))).persist()


def near_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Best near-equal partner of each left row; both sides have (id, name).

    Distinct names are compared, so equal names never meet row by row; the smallest id stands for a name on the right.
    A name that stands on the right as it is has its partner there: nothing is nearer.
    """
    a = left.filter(F.length("name") > 0).select("name").distinct()
    names = right.filter(F.length("name") > 0).groupBy("name").agg(F.min("id").alias("other_id"))
    equal = a.hint("merge").join(names, "name").select("name", "other_id", F.lit(1.0).alias("similarity"))
    similarity = 1 - F.levenshtein("name", "other") / F.greatest(F.length("name"), F.length("other"))
    best = (
        candidates(a.hint("merge").join(names, "name", "left_anti"), names.withColumnRenamed("name", "other"))
        .withColumn("similarity", similarity)
        .filter(F.col("similarity") > SIMILARITY)
        .groupBy("name")
        .agg(F.max(F.struct("similarity", (-F.col("other_id")).alias("neg"))).alias("m"))
        .select("name", (-F.col("m.neg")).alias("other_id"), F.round("m.similarity", 6).alias("similarity"))
    )
    return left.hint("merge").join(equal.unionByName(best), "name").select("id", "other_id", "similarity")


@job
def account_matches(crm_b_match_names: DataFrame, accounts: DataFrame) -> DataFrame:
    """Domain first, then the best near-equal name, then the manual map."""
    company = crm_b_match_names
    by_domain = accounts.groupBy("domain").agg(F.min("account_id").alias("domain_id"))
    near = near_names(company.select("id", "name"), accounts.select(F.col("account_id").alias("id"), F.lower("account_name").alias("name")))
    by_name = near.select("id", F.col("other_id").alias("name_id"), "similarity")
    found = cases([(F.col("domain_id").isNotNull(), "domain"), (F.col("name_id").isNotNull(), "name"), (F.col("manual_id").isNotNull(), "manual")], "none")
    return company.hint("merge").join(by_domain, "domain", "left").hint("merge").join(by_name, "id", "left").select(
        F.col("id").alias("company_id"), found.alias("matched_by"), F.coalesce("domain_id", "name_id", "manual_id").alias("account_id"), "similarity"
    )

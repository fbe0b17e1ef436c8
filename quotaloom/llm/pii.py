"""Personal data: generators propose overlapping spans, gradient-boosted trees score them, calibrated thresholds choose.

Everything on the path of the documents is DataFrame functions.  The trees are fitted by Spark's own GBTClassifier on the
spans of all texts, counted by their features, and applied as plain conditional expressions inside the projection, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, store

KINDS = ("email", "ip", "card", "phone")
#: Per kind: what a text must hold at all, the base pattern, a wider one.  The base patterns are the contract's, with
#: possessive loops and starts at the edge of a run: the same matches, in linear time and without deep recursion.
GENERATORS = {
    "email": ("@|\\(at\\)|\\[at\\]", "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\\(at\\)|\\[at\\]) ?[A-Za-z0-9-]++(?:(?:\\.| ?\\(dot\\) ?| ?\\[dot\\] ?)[A-Za-z0-9-]++)++"),
    "ip": ("[0-9]\\.[0-9]", "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]+", "(?<![0-9])[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}(?![0-9])"),
    "card": ("[0-9](?:[ -]?[0-9]){13}", "[0-9]++(?:[\\x20-][0-9]++)*+", "(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{2,4}(?![0-9])"),
    "phone": ("\\+|[0-9]{3}[). -]{1,2}[0-9]{3}[ .-][0-9]{4}", "\\+[0-9][\\x20().0-9-]+[0-9]", "(?:\\+?[0-9]{1,3}[ .-]?)?\\(?(?<![0-9])[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: Fixed value: words before a span that speak for personal data.
CONTEXT = "(?i)(?:mail|contact|write|call|phone|tel|mobile|fax|host|server|addr|card|visa|pay|account)\\W*$"
#: Format and context of a span.  The contract's check of a kind (Luhn, parts up to 255, digit counts) is the label and
#: is not among them: the trees learn which formats and contexts make a span pass it.
FEATURES = ("kind", "digits", "letters", "marks", "chars", "groups", "plus", "at", "after_word", "before_word", "context")
CONTEXT_FEATURES = ("after_word", "before_word", "context")
SPAN = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,label:boolean,features:array<double>>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("found"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["found"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.reverse(number)

    def weighed(i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The contract's check of a kind."""
    number = digits(value)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        strip = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "\\."), lambda p: F.when(F.length(strip(p)) <= 3, F.concat(F.lit("0"), strip(p)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    return F.length(number).between(10, 15)


def candidates(text: Column, kind: str) -> Column:
    """All proposed spans of a kind with their features; ``base``: a span of the contract; ``label``: format and check hold."""
    gate, base, wide = GENERATORS[kind]
    number = float(KINDS.index(kind))

    def described(own: bool):
        def one(c: Column) -> Column:
            v, ok = c["value"], valid(kind, c["value"])
            before = F.substring(text, F.greatest(c["start"] - 15, F.lit(1)).cast("int"), F.least(c["start"], F.lit(16)).cast("int"))
            after = F.substring(text, (c["end"] + 1).cast("int"), F.lit(1))
            size = lambda pattern: F.length(F.regexp_replace(v, pattern, "")).cast("double")
            flag = lambda c: c.cast("double")
            features = F.array(
                F.lit(number), size("[^0-9]"), size("[^A-Za-z]"), size("[A-Za-z0-9]"), F.length(v).cast("double"), F.size(F.split(v, "[^A-Za-z0-9]+")).cast("double"),
                flag(v.startswith("+")), flag(F.contains(v, F.lit("@"))), flag(after.rlike("\\w")), flag(before.rlike("\\w$")), flag(before.rlike(CONTEXT)),
            )
            return F.struct(c["start"].alias("start"), F.lit(int(number)).alias("kind"), c["end"].alias("end"), (ok if own else F.lit(False)).alias("base"), ok.alias("label"), features.alias("features"))

        return one

    spans = [F.transform(F.filter(located(text, base), lambda c: F.length(c["value"]) > 1), described(True)), F.transform(located(text, wide), described(False))]
    return F.when(text.rlike(gate), F.concat(*spans)).otherwise(F.array().cast(SPAN))


@dataclass
class PiiModel:
    """Boosted trees as nested (feature, threshold, left, right) tuples with leaves as numbers, and thresholds by kind.

    ``columns``: for each feature index of the trees, its place in ``FEATURES`` (all of them unless some were left out).
    """

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: Sequence[float] = (2.0, 2.0, 2.0, 2.0)  # above 1: no span beyond the base ones
    columns: Sequence[int] = tuple(range(len(FEATURES)))

    def margin(self, features: Column) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            i, at, left, right = node
            return F.when(features[self.columns[i]] <= F.lit(at), walk(left)).otherwise(walk(right))

        return sum((walk(t) * F.lit(w) for t, w in zip(self.trees, self.weights)), F.lit(0.0))

    def score(self, features: Column) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(features)))


def _tree(node) -> object:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trees: int = 12, depth: int = 3, precision: float = 0.98, features: Sequence[str] = FEATURES) -> PiiModel:
    """Fit on all spans of all texts, counted by their features.

    The label of a span is whether its kind's check holds; no feature holds that check, so the trees learn it from
    format and context (``features``, a subset of ``FEATURES``, lets some be left out, for ablation).  Three quarters of
    the texts, by a hash of text and id, fit the trees; on the rest, each kind's threshold is the least score from which
    on the share of labelled spans is ``precision``.  Equal spans are one row with their number as its weight, so the
    fit grows with the different forms of spans; split candidates come from all rows.
    Without spans of both labels the model adds nothing.
    """
    few = docs.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text")).where("text is not null")
    spans = few.select((F.pmod(F.xxhash64("id", "text"), F.lit(4)) == 0).alias("held"), F.explode(F.concat(*(candidates(F.col("text"), k) for k in KINDS))).alias("c"))
    each = spans.select("held", F.col("c.label").cast("double").alias("label"), *(F.col("c.features")[i].alias(f) for i, f in enumerate(FEATURES)))
    rows = store(each.groupBy("held", "label", *FEATURES).agg(F.count("*").cast("double").alias("n")), "pii-spans")
    fit = rows.where("not held")
    size = fit.agg(F.count("*"), F.count_distinct("label")).first()
    if size[1] < 2:
        return PiiModel()
    points = VectorAssembler(inputCols=list(features), outputCol="features").transform(fit)
    bins = max(32, math.isqrt(size[0]) + 1)  # Spark draws its split candidates from maxBins^2 rows: from all of them
    booster = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, checkpointInterval=-1, weightCol="n", maxBins=bins)
    fitted = booster.fit(points.select("label", "n", "features"))
    model = PiiModel([_tree(t._call_java("rootNode")) for t in fitted.trees], [float(w) for w in fitted.treeWeights], columns=tuple(FEATURES.index(f) for f in features))
    # Equal scores are one row: at most as many rows as the trees have different scores.
    scores = rows.where("held").groupBy(F.col("kind").cast("int").alias("kind"), model.score(F.array(*FEATURES)).alias("p")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right"))
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    reached = scores.withColumns({"n": F.sum("n").over(down), "right": F.sum("right").over(down)}).where((F.col("p") >= 0.5) & (F.col("right") >= precision * F.col("n")))
    least = {r["kind"]: r["p"] for r in reached.groupBy("kind").agg(F.min("p").alias("p")).collect()}
    model.thresholds = tuple(least.get(k, 2.0) for k in range(len(KINDS)))
    return model


def find(docs: DataFrame, model: PiiModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array<struct<start, kind, end, base>> of base spans and chosen further ones, in order.

    A further span is one that no base span of its kind overlaps and whose score reaches its kind's threshold.
    Null and empty texts have no span.  Rows and columns stay as they are; a column named ``pii`` is replaced.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    found = docs.withColumn("pii", F.concat(*(candidates(text, k) for k in KINDS)))
    at = F.array(*(F.lit(float(t)) for t in model.thresholds))
    base = F.filter("pii", lambda c: c["base"])
    more = F.filter("pii", lambda c: ~c["base"] & (model.score(c["features"]) >= at[c["kind"]]))
    more = F.filter(more, lambda c: ~F.exists(base, lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    few = lambda x, own: F.transform(x, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), F.lit(own).alias("base")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>")
    return found.withColumn("pii", F.when(F.size("pii") > 0, F.array_sort(F.array_distinct(F.concat(few(base, True), few(more, False))))).otherwise(none))


def listed(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", names[c["kind"]], c["start"], c["end"])), ",")


def report(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): numbers and digest of the base spans, list of all."""
    base = F.filter("pii", lambda c: c["base"])

    def number(kind: int) -> Column:
        return F.size(F.filter(base, lambda c: c["kind"] == kind)).cast("bigint")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(col(id_col), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def redact(found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The text with every found span, overlapping ones as one, replaced by ``[kind]`` of the first; drops ``pii``."""
    text, names = col(text_col), F.array(*map(F.lit, KINDS))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(c["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.when(c["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), names[c["kind"]], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), new.alias("out"))

    rest = F.aggregate("pii", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return found.withColumn(text_col, F.when(F.size("pii") > 0, rest).otherwise(text)).drop("pii")


def redacted(docs: DataFrame, model: PiiModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with base and chosen spans of ``text_col`` replaced by ``[kind]``; every other column, whatever its name
    (``pii`` too), comes out as it came in.  Null texts become empty ones; rows stay as they are."""
    inner = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    out = redact(find(inner, model))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))

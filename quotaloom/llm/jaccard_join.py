"""Exact n-gram Jaccard join: prefix filters under several global token orders, intersected before verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType, LongType, StructField, StructType

from .common import Forest, arrow_pass, col, components, slices, store, strings
from .hashing import U, mix, shingles, word_hashes

#: Tokens a task holds before it counts which of them repeat.
TOKENS_A_ROUND = 1 << 20
#: The order's table of frequent tokens is bounded (1.6 MB); which tokens it holds changes the work, never the result.
FREQUENT = 200_000
ORDERS = (U(0), U(0x5851F42D4C957F2D), U(0x14057B7EF767814F))


def token_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for lo, hi in slices(texts):
        words, first = word_hashes(texts[lo:hi])
        for i in range(hi - lo):
            yield np.unique(shingles(words[first[i] : first[i + 1]], k))


def signature(tokens: np.ndarray) -> int:
    """63-bit hash of a set."""
    return int(mix(mix(tokens).sum(dtype=U, keepdims=True) + U(len(tokens)))[0] >> U(1))


def linked(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def prefix_length(n: int, percent: int) -> int:
    """Any set that is similar enough shares at least ceil(percent * n / 100) tokens, so one of these first ones."""
    return n - -(-percent * n // 100) + 1 if n else 0


class Orders:
    """Global token orders: tokens outside the frequent table by a hash of their own, then the frequent ones, rarest first."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        at = np.argsort(frequent)
        self.frequent = frequent[at]
        self.rank = np.empty(len(at), U)  # of the frequent tokens by count
        self.rank[np.lexsort((self.frequent, counts[at]))] = np.arange(len(at), dtype=U)

    def hot(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are in the frequent table, and the rank of those."""
        if not len(self.frequent):
            return np.zeros(len(tokens), bool), np.zeros(0, U)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        hot = self.frequent[at] == tokens
        return hot, self.rank[at[hot]]

    def prefix(self, tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray, order: U, percent: int) -> np.ndarray:
        """Positions in ``tokens`` of the first ones in an order, by this order."""
        n = prefix_length(len(tokens), percent)
        place = mix(tokens ^ order) >> U(1)
        place[hot] = rank + U(1 << 63)
        first = np.argpartition(place, n)[:n] if n < len(tokens) else np.arange(len(tokens))
        return first[np.argsort(place[first])]


def repeated_tokens(docs: DataFrame, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that tasks saw again and again, with how many of all documents hold them as far as tasks saw repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            nonlocal size
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, int))
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["token", "n"])

        for batch in batches:
            for tokens in token_sets(strings(batch), k):
                held.append(tokens)
                size += len(tokens)
                if size >= TOKENS_A_ROUND:
                    yield counted()
        yield counted()

    counts = arrow_pass(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.array([r["token"] for r in rows], np.int64).view(U), np.array([r["n"] for r in rows], np.int64)


def indexed(docs: DataFrame, orders: Orders, k: int, percent: int) -> DataFrame:
    """One pass with three kinds of rows.

    ``token`` and ``hot`` null: (id, key, s, n, b, c) of every row: set signature (null without words) and size, and its
    prefixes under the second and third order as 32-bit values.  ``token``: (token, place, s, n) of the infrequent tokens of
    the prefix under the first order with their place in it, once per set and task.  ``hot``: (s, n, hot, tokens) of the sets that hold frequent
    tokens there, once per set and task: these tokens, and all tokens of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            s, n, b, c = [], [], [], []
            token, place, owner, size = [], [], [], []
            shared: dict[str, list] = {"s": [], "n": [], "hot": [], "tokens": []}
            for tokens in token_sets(strings(batch), k):
                n.append(len(tokens))
                s.append(own := signature(tokens) if len(tokens) else None)
                hot, rank = orders.hot(tokens)
                for out, order in ((b, ORDERS[1]), (c, ORDERS[2])):
                    out.append(tokens[orders.prefix(tokens, hot, rank, order, percent)].astype(np.uint32).view(np.int32))
                if own is None or own in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(own)
                at = orders.prefix(tokens, hot, rank, ORDERS[0], percent)
                rare = at[~hot[at]]
                token.append(tokens[rare])
                place.append(np.arange(len(rare)))  # the frequent ones come after them
                owner.append(np.full(len(rare), own, np.int64))
                size.append(np.full(len(rare), len(tokens), np.int64))
                if len(rare) < len(at):
                    for name, value in zip(shared, (own, len(tokens), tokens[at[hot[at]]].view(np.int64), tokens.tobytes())):
                        shared[name].append(value)
            if token:
                yield rows(token=owned(token), place=owned(place), s=owned(owner), n=owned(size))
            if shared["s"]:
                yield rows(**{name: pa.array(values, kinds[name]) for name, values in shared.items()})
            yield rows(id=batch.column("id"), key=batch.column("key"), s=pa.array(s, pa.int64()), n=pa.array(n, pa.int64()), b=pa.array(b, kinds["b"]), c=pa.array(c, kinds["c"]))

    def owned(parts: list[np.ndarray]) -> pa.Array:
        return pa.array(np.concatenate(parts).view(np.int64))

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        size = len(columns["s"])
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, kind)) for c, kind in kinds.items()], names=list(kinds))

    id_kind = docs.schema["id"].dataType
    kinds = {"id": to_arrow_type(id_kind), "key": pa.int64(), "s": pa.int64(), "n": pa.int64(), "b": pa.list_(pa.int32()), "c": pa.list_(pa.int32()), "token": pa.int64(), "place": pa.int64(), "hot": pa.list_(pa.int64()), "tokens": pa.binary()}
    return arrow_pass(docs.select("id", "key", "text"), run, f"id {id_kind.simpleString()}, key long, s long, n long, b array<int>, c array<int>, token long, place long, hot array<long>, tokens binary")


def small_lists(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of sets, with their sizes, that share an infrequent token of the first order's prefixes and
    can share enough tokens from there on: the first shared token of a linked pair has all others after it in both."""
    own = posted.select("token", "place", "s", "n")
    x, y = own.alias("x"), own.alias("y")  # one exchange serves both sides
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    fits = (F.col("x.s") < F.col("y.s")) & ((100 + percent) * rest >= percent * (F.col("x.n") + F.col("y.n")))
    pairs = x.join(y, F.col("x.token") == F.col("y.token")).where(fits)
    return pairs.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def other_orders(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes meet under the second and the third order too, with the keys of their documents.

    Of each prefix only that part counts, and is sent, which leaves enough tokens after it for this pair.
    """

    def head(prefix: str, size: str) -> Column:
        needed = f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"
        return F.slice(prefix, 1, F.expr(f"cast({size} - {needed} + 1 as int)"))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    classes = store(rows.join(wanted, "s").groupBy("s").agg(F.min_by(F.struct("key", "b", "c"), "key").alias("x")), "jaccard-candidates")
    x, y = (classes.select(F.col("s").alias(end), F.col("x.key").alias(f"k{end}"), F.col("x.b").alias("second"), F.col("x.c").alias("third")) for end in "ab")
    left = pairs.join(x, "a").select("a", "b", "na", "nb", "ka", head("second", "na").alias("xb"), head("third", "na").alias("xc"))
    both = left.join(y, "b")
    return both.where(F.arrays_overlap("xb", head("second", "nb")) & F.arrays_overlap("xc", head("third", "nb"))).select("a", "b", "ka", "kb")


def in_blocks(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` (s, cluster, ...) with the block of each set instead of its cluster: about ``block`` sets of few clusters."""
    buckets = max(1, -(-placed.count() // block))
    large = placed.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("s"), "parts"), F.lit(0))
    return placed.join(large, "cluster", "left").withColumn("block", F.pmod(F.xxhash64("cluster"), F.lit(buckets)) + part * buckets).drop("cluster", "parts")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Edges (a, b) that join the pairs whose texts are similar enough.

    Each set goes to a cluster named after the smallest of itself and its candidates, clusters to blocks of about
    ``block`` sets.  A text goes once to each pair of blocks in which it has candidates, not to every pair, and what is
    connected there already isn't compared again.
    """
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("ka").alias("key"), F.col("b").alias("other")), F.struct(F.col("b").alias("s"), F.col("kb").alias("key"), F.col("a").alias("other")))).alias("e")).select("e.*")
    placed = store(both.groupBy("s", "key").agg(F.least("s", F.min("other")).alias("cluster")), "jaccard-ends")
    placed = store(in_blocks(placed, block), "jaccard-placed")
    x, y = placed.select(F.col("s").alias("a"), F.col("block").alias("pa")), placed.select(F.col("s").alias("b"), F.col("block").alias("pb"))
    pairs = store(pairs.join(x, "a").join(y, "b").select("a", "b", F.least("pa", "pb").alias("lo"), F.greatest("pa", "pb").alias("hi")), "jaccard-placed-pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("s"), F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi")).distinct().join(placed.select("s", "key"), "s")
    texts = docs.select("key", "text").join(members, "key").select("s", "own_lo", "own_hi", "text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for s, tokens in zip(left.column("s").to_pylist(), token_sets(strings(left), k)):
            if signature(tokens) == s:  # else another text under a repeated id
                sets[s] = tokens
        forest = Forest()
        for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist()):
            if forest.root(a) != forest.root(b) and linked(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), len(sets[a]), len(sets[b]), percent):
                forest.join(a, b)
        return forest.stars()

    return texts.groupBy("own_lo", "own_hi").cogroup(pairs.groupBy("lo", "hi")).applyInArrow(run, "a long, b long")


def in_block(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Edges that join the linked sets of one pair of blocks."""

    def run(group: pa.Table) -> pa.Table:
        rows = {}
        for s, side, data in zip(*(group.column(c).to_pylist() for c in ("s", "side", "tokens"))):
            rows.setdefault(s, (side, data))
        ids = list(rows)
        side = np.array([rows[s][0] for s in ids])
        sets = [np.frombuffer(rows[s][1], U) for s in ids]
        size = np.array([len(x) for x in sets])
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        start = np.r_[0, np.cumsum(size)]
        mark, forest = np.zeros(len(vocabulary), np.int64), Forest()
        diagonal = not side.any()
        for i in range(len(ids)):
            if not diagonal and side[i]:
                continue
            own = flat[start[i] : start[i + 1]]
            mark[own] = 1
            inter = np.add.reduceat(mark[flat], start[:-1])
            mark[own] = 0
            near = 100 * inter >= percent * (size[i] + size - inter)
            near[i] = False
            if not diagonal:
                near &= side == 1
            for j in np.flatnonzero(near).tolist():
                forest.join(ids[i], ids[j])
        return forest.stars()

    return run


def meetings(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(s, lo, hi, side): the pairs of blocks to which the sets (s, n, hot) go, so that any two that share a frequent
    token and fit in size meet.

    A set's cluster is named after the smallest set of all its lists, and clusters go to blocks: near copies share most
    of their lists, so a set goes once to each block it shares a token with, whatever the number of these tokens.  A list
    that is spread over more than twice the blocks its length fills is cut into blocks of its own instead.
    """
    lists = store(sets.select("s", "n", F.explode("hot").alias("token")).distinct(), "jaccard-lists")
    heads = F.broadcast(lists.groupBy("token").agg(F.min("s").alias("head")))  # at most FREQUENT rows
    clusters = store(lists.join(heads, "token").groupBy("s").agg(F.min("head").alias("cluster")), "jaccard-list-clusters")
    placed = store(lists.join(in_blocks(clusters, block), "s"), "jaccard-list-blocks")
    lengths = placed.groupBy("token", "block").agg(F.count("*").alias("held")).groupBy("token").agg(F.ceil(F.sum("held") / block).alias("parts"), F.count("*").alias("blocks"))
    spread = F.broadcast(lengths.where("blocks > 2 * parts").select("token", "parts"))
    own = F.when(F.col("parts").isNull(), F.col("block")).otherwise(F.xxhash64("token", F.pmod("s", "parts")))
    placed = placed.join(spread, "token", "left").select("token", "s", "n", own.alias("own"))
    others = placed.groupBy("token", F.col("own").alias("other")).agg(F.count("*").alias("held"), F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    met = placed.join(others, "token").where(((F.col("own") != F.col("other")) | (F.col("held") > 1)) & fits)
    return met.select("s", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side")).distinct()


def large_lists(shared: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges among the sets (s, n, hot, tokens) that share a frequent token: every pair of blocks is one bounded group."""
    met = meetings(shared.select("s", "n", "hot"), percent, block)
    once = shared.groupBy("s").agg(F.first("tokens").alias("tokens"))  # equal in every task
    return met.join(once, "s").groupBy("lo", "hi").applyInArrow(in_block(percent), "a long, b long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the key, by which texts are fetched, is the id or else a hash of id and text."""
    few = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    return few.select("id", key_of(few.schema["id"].dataType).alias("key"), "text")


def key_of(kind: DataType) -> Column:
    other = F.xxhash64("id", "text")
    return F.coalesce(F.col("id").cast("long"), other) if isinstance(kind, IntegralType) else other


def grouped(docs: DataFrame, k: int, percent: int, frequent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, s, n) of every row of ``docs`` (id, key, text), and (s, root) of every set: equal roots are one group.

    1. Tokens that repeat are counted over all documents; the more frequent a token, the later in every order.
    2. Equal sets are one class.  Classes that share an infrequent token in their prefixes under the first order, with
       enough tokens after it, are candidates; they stay so if their prefixes also meet like that under the second and
       third order; then the texts decide.
    3. Sets that share frequent tokens are dealt to blocks, and each pair of blocks that shares one is compared as a
       group, so a large group of near copies emits a spanning forest and no pairs.
    """
    orders = Orders(*repeated_tokens(docs, k, frequent))
    every = store(indexed(docs, orders, k, percent), "jaccard-index")
    rows = every.where("token is null and hot is null").select("id", "key", "s", "n", "b", "c")
    posted, shared = every.where("token is not null"), every.where("hot is not null")
    pairs = store(small_lists(posted, percent), "jaccard-pairs")
    pairs = store(other_orders(pairs, rows.where("s is not null"), percent), "jaccard-filtered")
    edges = store(verified(pairs, docs, k, percent, block).unionAll(large_lists(shared, percent, block)), "jaccard-edges")
    roots = components(edges, name="jaccard-components")
    sets = rows.where("s is not null").select("s").distinct()
    named = sets.join(roots.withColumnRenamed("node", "s"), "s", "left").select("s", F.coalesce("component", "s").alias("root"))
    return rows.select("id", "key", "s", "n"), store(named, "jaccard-classes")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, frequent: int = 64, block: int = 256) -> DataFrame:
    """(id, n_shingles, component_id) of every row: size of its set of ``k``-word shingles and the smallest id reachable
    by links; two rows link when 100 * intersection >= ``percent`` * union.  Exact: no link is missed.

    Null and empty texts, and texts of white space, have the empty set and link with nothing.  Null ids take part, but
    are nobody's component id; a row none of whose group has an id gets null.  Repeated ids are rows of their own, each
    with its own set; texts of fewer than ``k`` words are one shingle.  Empty table: no rows.
    """
    rows, named = grouped(keyed(docs, id_col, text_col), k, percent, frequent, block)
    least = rows.where("s is not null").groupBy("s").agg(F.min("id").alias("least")).join(named, "s")
    by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = store(named.join(by_root, "root").select("s", "component_id"), "jaccard-named")
    out = rows.select("id", "s", F.col("n").alias("n_shingles")).join(by_set, "s", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("s").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, frequent: int = 64, block: int = 256) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay when each group of linked documents keeps one: that with the
    smallest id (null ids last).  Texts without a word stay; of rows equal in id and shingles one stays."""
    rows, named = grouped(keyed(docs, id_col, text_col), k, percent, frequent, block)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "s")).alias("x")
    kept = rows.where("s is not null").join(named, "s").groupBy("root").agg(first).select("x.key", "x.s")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [signature(t) if len(t) else None for t in token_sets([t or "" for t in batch.column("rest").field(place).to_pylist()], k)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("key"), pa.array(s, pa.int64())], names=["rest", "key", "s"])

    place = docs.columns.index(text_col)
    packed = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("rest"), col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    packed = packed.select("rest", key_of(packed.schema["id"].dataType).alias("key"))
    whole = arrow_pass(packed, signed, StructType([*packed.schema.fields, StructField("s", LongType())]))
    stay = whole.join(kept, ["key", "s"]).dropDuplicates(["key", "s"])
    return stay.select("rest.*").unionAll(whole.where("s is null").select("rest.*"))

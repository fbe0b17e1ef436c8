"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of possibly shared prefixes.

Every prefix of d turns gets a 128-bit digest: two running sums over its turns of 64-bit hashes of (place, role,
text), kept exact as decimals, so a prefix's digest follows from its parent's in one ordered window per
conversation.  A count-min sketch of all digests (four rows of ``width`` cells, counted by an aggregation and
joined back by broadcast) estimates how many conversations share each prefix.  An estimate never falls short, so
an estimate of one proves a singleton, and every longer prefix of that conversation is one too: those nodes (the
tail) are written from the conversation's own rows, without a shuffle.  Only the other prefixes are grouped by
digest, exactly.  The sketch's width follows the number of prefixes up to ``max_width``; beyond it more prefixes
are merely grouped, and results stay the same.

Subtree sums need no pass per depth.  Each node has a representative, its smallest member; a conversation is the
representative of a contiguous run of nodes on its path, from depth r to its end.  So the words of all nodes below
a node are the sums over its members of their words from depth r (or from the node's own depth), and its leaves
are the members that represent a childless node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_pass, col, store

WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ROWS = 4


def rebuilt(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20, borrowed: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): turns (c, d from 1, role, text) of every rebuilt conversation, and (c, n_turns) of all.

    Turns are ordered by turn (null first), then role and text; null role or text is empty.  Conversation c takes
    the first h = crc32(decimal c) % ``borrowed`` turns of conversation c - c % ``group`` (Spark's and SQL's
    remainder), then its own turns after its first h.  Rows with a null conversation id belong to none.
    """
    t = conversations.where(col(id_col).isNotNull()).select(
        col(id_col).cast("long").alias("c"), col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")
    )
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1).drop("turn")
    ids = t.select("c").distinct().select("c", (F.crc32(F.col("c").cast("string")) % borrowed).alias("h"), (F.col("c") - F.col("c") % group).alias("base"))
    own = t.join(ids.select("c", "h"), "c").where(F.col("pos") >= F.col("h")).select("c", "pos", "role", "text")
    lent = t.where(F.col("pos") < borrowed - 1).select(F.col("c").alias("base"), "pos", "role", "text")
    taken = lent.join(ids, "base").where(F.col("pos") < F.col("h")).select("c", "pos", "role", "text")
    turns = own.unionByName(taken).withColumn("d", F.row_number().over(Window.partitionBy("c").orderBy("pos"))).drop("pos")
    convs = ids.select("c").join(turns.groupBy("c").agg(F.count("*").alias("n_turns")), "c", "left").select("c", F.coalesce("n_turns", F.lit(0)).cast("long").alias("n_turns"))
    return turns, convs


def _ends_sha(rows: DataFrame) -> DataFrame:
    """(d, g1, g2, ends_sha256): SHA-256 of each node's ending members, ascending, comma-joined, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, out = None, None, []
        for batch in batches:
            for d, g1, g2, c in zip(*(batch.column(k).to_pylist() for k in ("d", "g1", "g2", "c"))):
                if (d, g1, g2) != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = (d, g1, g2), hashlib.sha256(str(c).encode())
                else:
                    h.update(b"," + str(c).encode())
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(("d", "g1", "g2", "ends_sha256"), r)) for r in out], schema=SCHEMA)
                out = []
        if key is not None:
            out.append((*key, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "g1", "g2", "ends_sha256"), r)) for r in out], schema=SCHEMA)

    ordered = rows.repartition("d", "g1", "g2").sortWithinPartitions("d", "g1", "g2", "c")
    return arrow_pass(ordered, run, "d long, g1 decimal(38,0), g2 decimal(38,0), ends_sha256 string")


SCHEMA = pa.schema([("d", pa.int64()), ("g1", pa.decimal128(38, 0)), ("g2", pa.decimal128(38, 0)), ("ends_sha256", pa.string())])


def trie(conversations: DataFrame, *, max_width: int = 1 << 20, **names: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its subtree's figures.

    A node is a distinct sequence of the first d turns (role, text), from the root (d = 0, all conversations,
    even turnless ones).  Columns (all long): conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens (over its
    subtree, each node's n_convs - 1 times the words of its last text), and ends_sha256 (string: SHA-256 of the
    decimal ids of members with exactly d turns, ascending, comma-joined; the empty string's hash if none).
    Empty table: no rows.  Repeated rows are repeated turns; ties of turn are ordered by role and text.
    Digests are 128 bits: two different prefixes of one length share one with odds of about 2**-128.
    """
    turns, convs = rebuilt(conversations, **names)
    convs = store(convs, "trie-convs")
    by_conv = Window.partitionBy("c").orderBy("d")
    h = [F.xxhash64(F.lit(k), "d", "role", "text").cast("decimal(38,0)") for k in (1, 2)]
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    running = by_conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = by_conv.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    p = turns.select(
        "c", "d", F.sum(h[0]).over(running).alias("g1"), F.sum(h[1]).over(running).alias("g2"), words.alias("w"), F.sum(words).over(rest).alias("wsuf"), F.count("*").over(Window.partitionBy("c")).alias("len")
    )
    p = p.select("*", *(F.coalesce(F.lag(g).over(by_conv), F.lit(0).cast("decimal(38,0)")).alias("p" + g) for g in ("g1", "g2")), *(F.lead(g).over(by_conv).alias("n" + g) for g in ("g1", "g2")))
    p = store(p, "trie-prefixes")
    total = p.count()
    width = min(max_width, 1 << max(10, (2 * total).bit_length()))
    cell = [F.pmod(F.xxhash64(F.lit(100 + j), "g1", "g2"), F.lit(width)).alias(f"cell{j}") for j in range(ROWS)]
    base = p = p.select("*", *cell)
    for j in range(ROWS):
        counts = base.groupBy(f"cell{j}").agg(F.count("*").alias(f"est{j}"))  # at most ``width`` rows
        p = p.join(F.broadcast(counts), f"cell{j}")
    p = p.withColumn("est", F.least(*(F.col(f"est{j}") for j in range(ROWS))))
    p = p.withColumn("f", F.coalesce(F.min(F.when(F.col("est") == 1, F.col("d"))).over(Window.partitionBy("c")), F.col("len") + 1))
    p = store(p.select("c", "d", "g1", "g2", "pg1", "pg2", "ng1", "ng2", "w", "wsuf", "len", "f"), "trie-screened")

    zero = F.lit(0).cast("decimal(38,0)")
    first = p.where("d = 1").select("c", F.col("g1").alias("ng1"), F.col("g2").alias("ng2"), F.col("wsuf"))
    root = convs.join(first, "c", "left").select(
        "c", F.lit(0).cast("long").alias("d"), zero.alias("g1"), zero.alias("g2"), F.lit(None).cast("decimal(38,0)").alias("pg1"), F.lit(None).cast("decimal(38,0)").alias("pg2"),
        "ng1", "ng2", F.lit(0).cast("long").alias("w"), F.coalesce("wsuf", F.lit(0)).cast("long").alias("wsuf"), F.col("n_turns").alias("len"),
    )
    shared = p.where("d < f").drop("f").unionByName(root)
    tails = p.where("d >= f")

    node = ["d", "g1", "g2"]
    nodes = store(
        shared.groupBy(*node).agg(
            F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.countDistinct("ng1", "ng2").alias("n_children"), F.max("w").alias("w"),
            F.max("pg1").alias("pg1"), F.max("pg2").alias("pg2"), F.sum("wsuf").alias("all_words"), F.min_by("wsuf", "c").alias("rep_wsuf"),
        ),
        "trie-nodes",
    )
    # per conversation: the depth r from which it represents its nodes, their words from r, and whether it ends in a leaf
    reps = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("d").alias("r"), F.min_by("rep_wsuf", "d").alias("rep_words"), F.max(F.col("n_children") == 0).alias("leaf"))
    tail_top = tails.where("d = f").select("c", F.col("d").alias("tail_r"), F.col("wsuf").alias("tail_words"))
    scal = convs.select("c").join(reps, "c", "left").join(tail_top, "c", "left").select(
        "c",
        F.coalesce("r", "tail_r").alias("r"),
        F.coalesce(F.when(F.col("r").isNotNull(), F.col("rep_words")), "tail_words", F.lit(0)).alias("rep_words"),
        (F.coalesce("leaf", F.lit(False)) | F.col("tail_r").isNotNull()).cast("long").alias("leaf"),
    )
    x = F.when(F.col("r").isNull() | (F.col("r") > F.col("d")), F.col("rep_words")).otherwise(F.col("wsuf"))
    below = shared.join(scal, "c").groupBy(*node).agg(F.sum(x).alias("distinct_words"), F.sum("leaf").alias("n_leaves"))
    ends = _ends_sha(shared.where(F.col("d") == F.col("len")).select(*node, "c"))
    parents = nodes.select(F.col("d").alias("pd"), F.col("g1").alias("qg1"), F.col("g2").alias("qg2"), F.col("conv_id").alias("parent_conv_id"))
    is_parent = (F.col("pd") == F.col("d") - 1) & (F.col("qg1") == F.col("pg1")) & (F.col("qg2") == F.col("pg2"))
    out_shared = (
        nodes.join(below, node)
        .join(ends, node, "left")
        .join(parents, is_parent, "left")
        .select(
            "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long"),
            (F.col("all_words") - F.col("distinct_words")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )
    top_parent = tails.where("d = f").join(parents, is_parent, "left").select("c", "d", "parent_conv_id")
    out_tails = tails.join(top_parent, ["c", "d"], "left").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("parent_conv_id", F.col("c")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("d") == F.col("len"), F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    return out_shared.unionByName(out_tails)

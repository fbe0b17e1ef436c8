"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, embedding_itq, jaccard_join, licenses, order_minhash, packing, pii, prefix_trie, suffix_dedup, token_counts, toxicity, whitening
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_pairs(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.find(docs, pii.train(docs)))


def op6_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels nothing may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_bpe, op3_order_minhash, op4_suffix_dedup, op5_pii, op6_embedding_itq, op7_toxicity, op8_licenses, op9_token_counts, op10_jaccard_join, op11_byte_bpe, op12_whitening, op13_prefix_trie)
}

#: Words that white space separates, A-Z in lower case.
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

def _crc32_sql(x: str) -> str:
    """crc32 of the decimal text of ``x`` in DuckDB SQL, bit by bit (DuckDB has no crc32)."""
    step = "xor(c0, b)"
    for _ in range(8):
        step = f"xor(({step}) >> 1, CASE WHEN (({step}) & 1) = 1 THEN 3988292384 ELSE 0 END)"
    body = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c0, b: {step})"
    return f"xor({body}, 4294967295)"


TRIE_SQL = f"""
    WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT c, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS s FROM t GROUP BY c),
    h AS (SELECT c, s, {_crc32_sql("c")} % 4 AS h FROM o),
    r AS (SELECT h.c, list_concat(coalesce(list_slice(b.s, 1, h.h), []), list_slice(h.s, h.h + 1, len(h.s))) AS seq FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
    p AS (SELECT c, d, len(seq) AS n, list_slice(seq, 1, d) AS pre, CASE WHEN len(seq) > d THEN list_slice(seq, 1, d + 1) END AS nxt FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
    nodes AS (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, count(DISTINCT nxt) AS n_children,
              sha256(array_to_string(list_sort(coalesce(list(c) FILTER (WHERE n = d), [])), ',')) AS ends_sha256,
              CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(pre[d].t, '[^\\x20\\x09-\\x0D]+')) END AS w FROM p GROUP BY pre, d),
    below AS (SELECT a.pre, a.d, count(*) FILTER (WHERE q.n_children = 0) AS n_leaves, sum((q.n_convs - 1) * q.w) AS saved_tokens
              FROM nodes a JOIN nodes q ON q.d >= a.d AND list_slice(q.pre, 1, a.d) = a.pre GROUP BY a.pre, a.d)
    SELECT n.conv_id, n.d::BIGINT AS depth, par.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
           b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b ON b.pre = n.pre AND b.d = n.d LEFT JOIN nodes par ON par.d = n.d - 1 AND par.pre = list_slice(n.pre, 1, n.d - 1)"""


ORACLE_SQL = {
    "op4_suffix_dedup": f"""
        WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
        texts AS (SELECT w, min(doc_id) AS first_doc_id, count(*) AS copies FROM docs GROUP BY w),
        spots AS (SELECT first_doc_id AS doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS spot FROM texts),
        windows AS (SELECT doc_id, spot, md5(array_to_string(w[spot + 1 : spot + 50], ' ')) AS h FROM spots),
        shared AS (SELECT h, min(doc_id) AS first_doc_id FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
        hits AS (SELECT doc_id, first_doc_id, spot, spot - row_number() OVER (PARTITION BY doc_id, first_doc_id ORDER BY spot) AS island
                 FROM (SELECT DISTINCT doc_id, first_doc_id, spot FROM windows JOIN shared USING (h)))
        SELECT doc_id, min(spot)::BIGINT AS start_word, (max(spot) - min(spot) + 50)::BIGINT AS n_words, first_doc_id, doc_id <> first_doc_id AS removed
        FROM hits GROUP BY doc_id, first_doc_id, island
        UNION ALL
        SELECT d.doc_id, 0::BIGINT, len(d.w)::BIGINT, t.first_doc_id, d.doc_id <> t.first_doc_id
        FROM docs d JOIN texts t ON d.w = t.w WHERE t.copies > 1 AND len(d.w) >= 50""",
    "op6_embedding_itq": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
        reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM c LEFT JOIN n ON n.a = c.vec_id""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') || ' ' || least(len(w), 4) AS s
                     FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
        reach AS (SELECT doc_id, doc_id AS r FROM docs UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id
        FROM docs d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY ALL""",
    "op13_prefix_trie": TRIE_SQL,
}

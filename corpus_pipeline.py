"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages and personal data
are cut out, and what is left is packed into training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.llm import jaccard_join, packing, pii, suffix_dedup, toxicity
from quotaloom.llm.common import store, table
from quotaloom.llm.queries import BYTE_BPE, held_out


def measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 % of their five-word shingles; ``op10_jaccard_join`` has a contract of its own (four, 85 %)."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(suffix_dedup.without(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base and chosen spans replaced by ``[kind]``; null texts become empty; all columns and rows kept."""
    return measured(pii.redacted(docs, pii.train(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Trained models and tokenizers have no SQL form; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

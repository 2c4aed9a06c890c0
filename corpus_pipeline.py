"""Training-corpus pipeline: toxicity, near-duplicates, repeated passages, contamination, tokens.

Each stage takes what its predecessor kept. A document goes if it is toxic, if a document with a
smaller id is its near-duplicate, if nothing but passages of documents with smaller ids is in it, or
if a benchmark window hits it; repeated passages are cut from documents that stay. The last stage
returns each remaining document's ids and decoded text as digests.

Null texts count as empty ones: they are near-duplicates of each other and otherwise pass; of rows
with the same id and text one stays, like of any near-duplicates; null ids are the largest; an empty
table passes through every stage; columns besides those of documents are not carried, and those that
are missing are null.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import common, decontaminate, sentencepiece_codec, simhash_vptree, suffix_dedup, toxicity_cnn

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """The columns of documents."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast("long" if c == "n_chars" else "string").alias(c) for c in COLUMNS])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_cnn.drop_toxic(_plain(docs), common.table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_vptree.one_of_each(_plain(docs))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated bytes; a document that had some cut and has no word left goes."""
    cut = suffix_dedup.repeated_bytes(_plain(docs), want_text=True, carry=("lang", "source"))
    left = cut.where(~((F.col("n_removed") > 0) & ~F.col("kept").rlike(r"\S")))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(_plain(docs), common.table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the stages; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage but the last is written in the shared folder.

    What a stage wrote is deleted when the next one has been written; only the last folder stays, for the result.
    """
    docs = common.texts(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark).rstrip('/')}/flowloom-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if k:
            common.drop_files(docs)
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

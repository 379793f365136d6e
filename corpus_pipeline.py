"""The corpus pipeline: quality rules, near duplicates, repeated strings, mixing, and token ids.

Each stage works on all that the stage before it kept. Null and empty texts fail the quality rules and so go in
the first stage. All stages but the last return the columns of their input.

* quality: rows that fail a rule go (`hostlight.llm.quality`).
* near_duplicates: of each group of documents with a Jaccard similarity of 0.8 or more on five-word shingles, the
  one with the least doc_id stays (`hostlight.llm.jaccard_join`).
* repeated_strings: bytes covered by a 100-byte string that starts earlier in the corpus are cut out, whole
  characters only; texts of which nothing is left go (`hostlight.llm.suffix_dedup`).
* mixing: documents are taken by source budgets of 60 % of all tokens, once each at most (`hostlight.llm.mixing`).
* encoding: token ids, and digests of ids and decoded text (`hostlight.llm.bpe`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostlight.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from hostlight.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, max_epochs=1)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, "doc_id", "text", bpe.vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Near duplicates and byte strings can't be expressed in SQL at this size; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

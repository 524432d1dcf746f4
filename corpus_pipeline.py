"""The corpus pipeline: quality, near-duplicates, repeated paragraphs, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of
``documents``, the last one packed sequences. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.llm import common, mixing, near_copies, packing, paragraphs, quality, registry

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below one half. It learns from labels that aren't held out."""
    model = quality.learn(docs, registry.not_held_out(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.accepted(docs.select(*COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class: five-word shingles alike at 0.8 or more."""
    return near_copies.deduplicated(docs.select(*COLUMNS))


def paragraph_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes all but the first occurrence of a repeated paragraph; n_chars follows."""
    d = paragraphs.without_repeats(docs.select(*COLUMNS))
    return d.withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the sources to their targets: a row per taken copy, the last one of a source cut after the words it serves."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place there; a document mixed in twice has two sets of pieces."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", paragraph_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: Fingerprints, tokens and the learnt model can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, "stage")
    return docs

"""A training-data pipeline over documents: each stage is one operator, and each reads what its predecessor kept as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm import packing, pii, simhash, suffix_dedup, toxicity
from strandloom.llm.common import shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects; it learns from all labels of the documents at hand."""
    model = toxicity.fit(*toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"), held_out=False))
    return toxicity.without_toxic(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates: five-word shingles of similarity 0.8 or more."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of the texts what a string of 100 bytes covers that also starts earlier."""
    return suffix_dedup.with_repeats_removed(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts its kind in brackets for each piece of personal data."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences of at most 2048."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("simhash near-dedup", simhash_stage), ("suffix-array dedup", suffix_stage), ("pii", pii_stage), ("best-fit packing", packing_stage)]
#: SQL can't express the fitted model, XXH64 or the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: quality rules, near duplicates, benchmark contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result as
Parquet in the shared folder and reads it again as the next one's documents, so that a lost executor
costs at most one stage. What a stage stored besides, and the documents that it read, are deleted once
its result is written; the last stage's documents stay for as long as its result is read.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hopgrid.llm import bpe, decontaminate, pii, quality, simhash
from hopgrid.llm.text import small_batches
from hopgrid.session import delete, scratch, shared_dir

TOKENIZER = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Near copies: some fingerprint of NEAR_PRINTS over shingles of NEAR_WORDS words differs in NEAR_BITS bits at most.
#: Wider than the operator's own contract, which meets few copies with a similarity of 0.8 over five words.
NEAR_BITS, NEAR_WORDS, NEAR_PRINTS = 4, 2, 4


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs, NEAR_BITS, NEAR_WORDS, NEAR_PRINTS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one), ("decontaminate", keep_clean), ("pii", redact), ("bpe", encode)]

#: Perplexity, SimHash, the random field and BPE have no SQL form; tests hold `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

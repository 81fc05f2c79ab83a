"""Cleaning of a document corpus in stages, each written as Parquet and read again by the next.

1. toxicity: documents that the ordinal model rejects go;
2. SimHash near-dedup: of each group of documents whose fingerprints (three-word shingles) are linked at up to three
   differing bits, the one with the smallest doc_id stays;
3. benchmark decontamination: documents that hold a benchmark item, up to a tenth of edits, go;
4. secret scans: secrets in the texts are masked, all documents stay;
5. BPE encoding: (doc_id, n_tokens, ids, decoded) of every document that is left.

Null texts count as empty: they stay in stages 1, 3 and 4, are near copies of each other in stage 2, and have no tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from creditloom.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from creditloom.llm.queries import tokenizer_path
from creditloom.scratch import scratch_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the labelled documents among ``docs``."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs, size=3, radius=3)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, tokenizer_path())
    return coded.select("doc_id", F.expr("cast(length(ids) / 4 as bigint)").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("bpe_encoding", encoded),
]

#: SQL has neither the hash functions nor the fitted models of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is what the last stage returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

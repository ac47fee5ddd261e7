"""A training-data pipeline over `documents`: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet in the shared folder and read
again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import decontam, line_dedup, piece_codec, quality_crf, simhash
from pointloom.llm.common import bound_batches, remove_path, scratch, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores below 0.7 go."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; n_chars follows the text."""
    info = f"line_dedup_{uuid4().hex}"  # no column of docs has this name
    kept = line_dedup.line_dedup(docs, min_docs=10, min_chars=1, keep="none", info_col=info).drop(info)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType))
    return kept


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    bound_batches(spark)
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover 0.8 or more of the tokens of a test item of at least five go."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"), least=5)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document that is left."""
    bound_batches(spark)
    done = piece_codec.round_trip(F.col("text"), MODEL, with_ids=True)
    return docs.select("doc_id", done.alias("d")).select("doc_id", "d.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("sentencepiece", tokens),
]

#: A trained classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage, on its own input, and run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on all documents. A stage's table goes once the next one is written; the last stays for the result."""
    name = f"corpus-{uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (step, stage) in enumerate(STAGES):
        path = scratch(spark, f"{name}-{k}-{step}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs

"""Corpus pipeline: from raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that is written as Parquet and reread as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm import bpe, decontaminate, linededup, neardedup, quality
from larkspar.llm.common import Stash, dropped_with, fresh, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from the labels whose crc32 of the id modulo 3 is not 1."""
    learnt = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = quality.learn(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"), learnt=learnt)
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    scored = quality.classify(docs, model, keep=tuple(docs.columns), out=(score, predicted))
    return scored.filter(F.col(predicted) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of at least 40 code points that at least 5 documents hold, but from the one of the largest id; n_chars follows the text."""
    return linededup.dedup_lines(docs, counts=None).withColumn("n_chars", F.length("text").cast("bigint"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each component of documents with five-word shingle sets of similarity 0.8 or more."""
    return neardedup.near_dedup(docs, size=5)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold at least 0.8 of the five-word shingles of a benchmark item."""
    return decontaminate.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded by the multilingual byte-level ranks and decoded again."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("encoding", encode_stage),
]

#: SQL cannot express the classifier and the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder; what each stage keeps is written as Parquet in the shared folder and reread."""
    docs, written = read(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written.append(Stash(docs))
            docs = written[-1].df
    return dropped_with(docs, *written)

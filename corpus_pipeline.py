"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes what it gives as Parquet to the
shared folder and rereads it as the next stage's docs.  All stages but the last give the columns of documents.

- quality: documents that the base rule or the cascade rejects go.
- near_duplicates: of documents linked by 5-word shingles at a similarity of 0.8 or more, directly or over others,
  the one of the least doc_id stays (one without doc_id only where there is no other).
- decontaminate: runs of 8 or more words that stand in a benchmark item, and whole items of fewer words, are cut out; a document that
  consists of them by more than half goes.
- secrets: what a rule finds is replaced by [SECRET]; no document goes.
- pieces: the piece ids of each document, their number and checksum, and whether decoding gives the text back.

Null and empty texts are rejected by the first stage (fewer than 50 words).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import materialize, table
from lodegraph.llm.decontaminate import decontaminate
from lodegraph.llm.jaccard import one_of_each
from lodegraph.llm.pieces import encode_documents
from lodegraph.llm.quality import keep_good
from lodegraph.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encode_documents(docs.withColumn("text", F.coalesce("text", F.lit(""))), public_tokenizers.path("piece_bpe_32k.model"), keep, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: The cascade, shingle components and Viterbi paths are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

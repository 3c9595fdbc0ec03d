"""A corpus pipeline of five operators: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes what the one before it kept, from the documents' Parquet table, and returns the columns
of documents; the last returns the packed pieces.  Rows are whole documents of any size; an empty table
stays empty.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sloflow.llm import best_fit, decontaminate, queries, secret_scan, simhash_gray, toxic_gru
from sloflow.llm.common import ready, table, written

#: The stages train, search and pack; SQL expresses none of them as a whole.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from the labelled ones among ``docs``."""
    return toxic_gru.without_toxic(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest doc_id."""
    return simhash_gray.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secret_scan.redact(docs, public_tokenizers.path(queries.WORD_BPE))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return best_fit.pack(best_fit.pieces(docs, public_tokenizers.path(queries.WORD_BPE), end_id=1))


def _stage(function, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return function(ready(spark), docs, sf_dir)


STAGES = [(f.__name__, partial(_stage, f)) for f in (toxicity, near_duplicates, decontamination, secrets, packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs

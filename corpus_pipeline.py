"""The training-corpus pipeline: five stages over documents, each stored as Parquet before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabularium.llm import decontaminate, language_id, line_dedup, packing, simhash
from tabularium.llm.common import table
from tabularium.llm.queries import vocabulary
from tabularium.session import checkpoint_dir


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in."""
    return language_id.keep_identified(docs, language_id.sample(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document, or an earlier part, holds already."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack),
]

#: Suffix automata, MinHash, Gray-order search, alignment and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared checkpoint folder, which goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        docs, before = spark.read.parquet(path), path
    return docs

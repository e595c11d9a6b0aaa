"""A pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, packing.

Each stage gets what the stage before kept, takes its decisions on all of it, and (but for the last) returns the rows
that stay with the columns of ``documents``. Stages are written as Parquet and read again, so a lost executor costs
the tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontamination, exact_dedup, language_id, ngram_jaccard, packing
from cloakframe.llm.common import documents, mark, materialize, release_since, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determinable language: null texts and texts without a letter. The language found
    replaces a missing one; if no row is labelled to learn from, a missing one stays missing."""
    net = language_id.fit(docs.where(~language_id.held_out()))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = unused(docs, "_pred")
    found = language_id.predict(docs, net, keep=name)
    return found.where(F.col(name) != language_id.UNDETERMINED).withColumn("lang", F.coalesce("lang", name)).drop(name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs, exact_dedup.fresh_index(spark))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the document with the smallest doc_id stays."""
    return ngram_jaccard.representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("leaks", leaks), ("packed", packed)]

#: Training a network and cutting tokens are not SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    point = mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
        release_since(spark, point, keep=docs)  # what the stage needed, and its input
    return docs

"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

quality rules -> near-duplicates -> repeated strings -> benchmark passages -> mix.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, mixing, rules, semantic, suffix
from tidemark.llm.common import scratch, table


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Each row stands or falls by its own text, whatever repeats its doc_id or
    has none; null and empty texts have fewer words than the rules ask for and
    go; texts of any length are counted whole; no rows give no rows.
    """
    return rules.kept_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id.

    A row without doc_id joins no class and stays; of rows that share the least
    doc_id of a class one is kept; a text without a word is a class of its own;
    long texts are compared whole; no rows give no rows.
    """
    return bagminhash.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of suffix.PASSAGE bytes, some forty words, that occur earlier; n_chars is counted anew, emptied documents go."""
    cut = suffix.deduplicated(docs, keep="first", length=suffix.PASSAGE, anchor=suffix.PASSAGE_ANCHOR)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(F.col("text").isNull() | (F.length("text") > 0)).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away.

    Each row is judged by its text alone: rows that share a doc_id, or have
    none, go or stay apart; null and empty texts stay; a text of any length is
    searched whole; null items, and no items, take nothing away.
    """
    return semantic.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document of the mix.

    Null and empty texts have size 0 and are never taken; repeated rows and null
    doc_ids are rows of their own; a null source is the last one; a long text is
    cut into blocks of equal size; no rows give no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality rules", by_rules),
    ("near-duplicates", one_of_each),
    ("repeated strings", without_repeats),
    ("benchmark passages", without_benchmark),
    ("source mix", mixed),
]

#: Retrieval by a fitted latent space and by signatures isn't SQL: tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's documents are a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

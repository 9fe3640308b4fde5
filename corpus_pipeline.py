"""Corpus pipeline: documents in, packed training sequences out.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import language, packing, quality, simhash, substring
from llm.common import cut, remainder
from llm.queries import VOCABULARY


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null texts too), or that no learned language claims."""
    return language.keep_identified(docs, language.train(docs.where(remainder("doc_id", 4) != 2)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted to be of bad quality; learns from labels of the stage's own documents.

    Where these hold not both labels nothing can be told apart, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    return quality.keep_good(docs, quality.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id, documents without one last."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that another document keeps; n_chars follows the text, and a document that is left without a word goes."""
    found = substring.remove_repeats(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in found.columns else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("simhash_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: No stage but the plainest counts can be said in SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder before the next.

    Every row is a document: ids may be null or repeat, texts may be null, empty or long, and further
    columns stay until the last stage. Empty tables give an empty result. ``llm.common.drop_scratch``
    deletes what lies in the shared folder, once the result has been read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from `documents`: five stages, each on all that its predecessor kept.

quality classifier -> n-gram Jaccard join -> substring dedup -> mixing to target weights -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm import jaccard, mixing, packing, quality, substrings
from paneloom.plans.shared import checked_broadcast, clear, mark, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.with_quality(docs, labels).where(F.col("p_quality") >= quality.THRESHOLD).select(*docs.columns)


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with 5-word shingles of Jaccard similarity 0.8 or more, the one of smallest id."""
    linked = jaccard.link_documents(docs, n=5, threshold=(80, 100))
    others = materialize(linked.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    return docs.join(checked_broadcast(others), "doc_id", "left_anti").select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that stand in a document of smaller id; documents with no word left go."""
    cleaned = substrings.remove_repeats(docs, removed_col="__removed")
    cleaned = cleaned.where((F.col("__removed") == 0) | (F.length("text") > 0)).drop("__removed")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_first_of_near_copies),
    ("substring dedup", remove_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: SQL has no tokenizer, classifier or suffix automaton; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all of `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i + 1}")
            clear(spark, since, keep=docs)
    return docs

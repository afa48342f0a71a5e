"""The corpus pipeline: toxic documents go, near copies go, repeated passages go,
sources are mixed to their weights, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm.minhash import drop_near_duplicates
from fleetlens.llm.mixing import mix
from fleetlens.llm.paragraphs import drop_repeated_paragraphs
from fleetlens.llm.pieces import encode_documents
from fleetlens.llm.queries import piece_model
from fleetlens.llm.toxicity import drop_toxic, fit

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Learned from the labels of ``sf_dir``."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the paragraphs that stand earlier."""
    return drop_repeated_paragraphs(docs.select(*COLUMNS)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, spread evenly over domains, languages and sources
    as far as they reach. Each document at most once: copies would undo the stages before."""
    return mix(docs.select(*COLUMNS), fraction=0.9, max_epochs=1).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, piece_model())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: Learned scores, signatures and segmentations are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage is kept before the next one reads it."""
    from fleetlens.llm.common import forget, keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name)
            if i:
                forget(given)
    return docs

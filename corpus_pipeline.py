"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import minhash, packing, quality, substring, toxicity
from braidwork.llm.common import documents, stored
from braidwork.llm.queries import labels, pattern, vocabulary

#: Least quality score, and the toxicity score from which a document goes.
LEAST_QUALITY, MOST_TOXIC = 0.3, 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality.score(docs, labels(spark, sf_dir))
    return scored.where(F.col("quality_score") >= LEAST_QUALITY).drop("quality_score")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field doesn't reject."""
    scored = toxicity.scores(docs, labels(spark, sf_dir))
    return scored.where(F.col("toxic_score") < MOST_TOXIC).drop("toxic_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.kept_rows(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that occur elsewhere."""
    return substring.removed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), pattern())


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", best_fit_packing),
]

#: Classifiers, minima and best fit have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

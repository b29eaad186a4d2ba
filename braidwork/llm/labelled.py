"""A bounded sample of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Documents of each class that a classifier is fitted on, and code points of all of a class's documents together.
EACH, POINTS = 1400, 40_000_000


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label of what a classifier may learn from: folds but 0, the largest label of a document."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    return known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))


def share(labels: DataFrame, column: str) -> float:
    """The share of label 1 among all known labels, slightly smoothed."""
    r = known_labels(labels, column).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("y"), F.count("*").alias("n")).first()
    return (r.y + 0.5) / (r.n + 1)


def sample(docs: DataFrame, labels: DataFrame, column: str, each: int = EACH, points: int = POINTS) -> tuple[list[str], list[int]]:
    """Texts and labels of up to `each` rows of either class, whose fold isn't 0, in order of a hash of doc_id.

    Only rows with an id, a text and a label count; a document with several labels takes the
    largest. Texts of any length teach, but those that `points` code points of a class, in that
    order, have no more room for. Ids and lengths of 2 * each rows come to the driver, then the texts.
    """
    known = known_labels(labels, column)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("n")]
    there = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.length("text").cast("long").alias("n")).join(known, "doc_id")
    chosen: list[tuple[int, int]] = []
    for c in (0, 1):
        left = points
        for r in there.where(F.col("label") == c).orderBy(*order).limit(each).collect():
            if r.n <= left:
                left -= r.n
                chosen.append((r.doc_id, r.label))
    ids = docs.sparkSession.createDataFrame(sorted(set(chosen)), "doc_id long, label int")
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * each).collect()
    return [r.text for r in rows], [r.label for r in rows]

"""What the two classifiers share: labelled rows within a documented bound, and measures of a ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, text, label): at most `bound` rows of each label that are not held out, the same in every run.

    Rows are drawn by a hash of their id. The ids are at most 2 * bound, so they are broadcast, and only
    the drawn texts are shuffled. Of several labels of one id the highest counts; of several rows of one
    id the one whose text has the smallest hash, so the rows are bounded as well.
    """
    known = (
        labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (remainder(modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("label"))
    )
    picked = [known.filter(F.col("label") == k).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    return one.select("doc_id", F.col("r.text").alias("text"), "label")


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Probability that a row of label 1 scores above one of label 0, ties counting half."""
    score, label = np.asarray(score, float), np.asarray(label)
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    ones = label.sum()
    zeros = len(label) - ones
    return float((rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)) if ones and zeros else 0.5

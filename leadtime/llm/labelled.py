"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod FOLDS is 0 are held out and never learnt from.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from all fitting; a null doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled(documents: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int]) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` learnable rows of each label (a pair: of label 0 and of label 1).

    Taken are those with the smallest hash of doc_id. The one bounded step of a fit: ids are chosen first, so that only the
    texts chosen move. Rows without text, doc_id or label do not count; of repeated labels the smallest counts.
    """
    zeros, ones = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("y = 0").orderBy(*order).limit(zeros).unionByName(known.filter("y = 1").orderBy(*order).limit(ones))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

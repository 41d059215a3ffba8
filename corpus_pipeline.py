"""Corpus pipeline: from ``documents`` to packed training sequences.

Stages, in this order: the quality classifier drops what it rejects; the n-gram Jaccard join leaves one document of each group;
the secret scan masks secrets in the texts; mixing orders the rows so that sources interleave to their target weights; best-fit packing places the
tokenised texts in sequences, which follow the order of the rows. Every stage works on all rows of the stage before; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadtime.llm import jaccard_join, mixing, packing, quality, secrets
from leadtime.llm.common import in_row_order, materialize, read_table
from leadtime.llm.queries import TARGET_WEIGHTS, tokenizer_file


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated score is under 0.3.

    Null and empty texts have the score of the empty text; a score of 0.3 stays; repeated rows stay or go together; null doc_ids are judged by their
    text alone; all columns stay as they are; no documents give no rows.
    """
    return quality.kept(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each component of 0.8-alike 5-word shingle sets: the one with the smallest doc_id.

    Of several rows under that doc_id the one with the smallest text hash stays, of equal rows one. Texts without words, nulls included, are
    alike to nothing: one row of each doc_id stays. Rows without doc_id stay unless a linked row has one. All columns stay as they are.
    """
    return jaccard_join.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets that the forest confirms; no document goes.

    Where that changes a text n_chars is counted anew; all else stays, nulls and repeated rows included. A score equal to the cut is a secret.
    """
    return secrets.redacted(docs, secrets.learn(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders all documents by their place in the mixture; the written table holds the order.

    A null source is a source of its own; null, empty and repeated rows are rows like any others, equal ones in any order; all columns stay as they are.
    """
    return mixing.ordered(docs, TARGET_WEIGHTS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences, pieces of a length and sequences in the order of ``docs``.

    Null and empty texts are one piece of the end id alone; longer texts are cut, never dropped; repeated rows and null doc_ids are packed like any
    others; other columns are not read.
    """
    return packing.pack_documents(in_row_order(docs, "__place"), tokenizer_file("word_bpe_49k.json"), place="__place")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express training and packing; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

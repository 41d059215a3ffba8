"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, jaccard_join, mixing, neighbours, packing, quality, secrets, sharding, toxicity, url_filter
from .common import materialize, read_table


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary files of public tokenizers lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels")
    return url_filter.filter_urls(pages, url_filter.outcomes_from_labels(pages, labels))


#: Shares of the mixture; a source not named has 1.
TARGET_WEIGHTS = {"src0": 6, "src1": 4, "src2": 4, "src3": 3, "src4": 3, "src5": 2, "src6": 2}


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    found = materialize(secrets.candidates(documents), "findings")
    return secrets.scan(documents, secrets.learn(documents, found=found), found=found)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"), TARGET_WEIGHTS)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return toxicity.scores(documents, toxicity.train(documents, read_table(spark, sf_dir, "labels")))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return quality.scores(documents, quality.train(documents, read_table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path or tokenizer_file("word_bpe_49k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_fingerprint": op2_fingerprint,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_neighbours": op7_neighbours,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = {"op3_url_filter": url_filter.oracle_sql()}

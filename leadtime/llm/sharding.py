"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked


def stratified_shards(rows: DataFrame, n_shards: int, seed: int = 17, stratum: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Cut ``rows`` into ``n_shards`` shards whose sizes differ by one row at most and whose mixture of strata matches the whole.

    Rows are shuffled within each stratum by a seeded hash and ranked; rank r of n gets the
    fraction (2r+1)/2n, and the shards are equal cuts of the order by fraction. So each
    shard holds of each stratum its share to within about a row. Both ranks are two-level (``common.ranked``): no
    stratum and no shard is ever sorted in one task, and only the columns given travel.

    Adds ``shard`` (int from 0), ``slot`` (bigint, gapless from 0 in each shard). Nulls in ``stratum`` are a
    stratum of their own; null keys are legal; equal rows take neighbouring ranks in any order; an
    empty table gives no rows. ``rows`` must be narrow and repeatable.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    own = list(rows.columns)
    base = rows.select(
        *own,
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("__stratum"),
        F.xxhash64(*[F.col(c) for c in own], F.lit(seed)).alias("__seeded"),
    )
    base = materialize(base, "shard-rows")
    order = [F.col(k) for k in keys]
    first = ranked(base, ["__stratum"], order, F.col("__seeded"), "__rank")
    fraction = (2 * F.col("__rank") + 1) / (2 * F.col("__rank_n"))
    first = materialize(first.withColumn("__at", F.shiftleft((fraction * F.lit(float(2**53))).cast("long"), 11)), "shard-ranks")
    second = ranked(first, [], [F.col("__stratum"), F.col("__rank")], F.col("__at"), "__place")
    exact = second.withColumn("__shard", F.expr(f"(__place * {n_shards}) div __place_n"))
    return exact.select(
        *own,
        F.col("__shard").cast("int").alias("shard"),
        F.expr(f"__place - ((__shard * __place_n + {n_shards} - 1) div {n_shards})").alias("slot"),
    )


def shard_documents(documents: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """Every document's shard and slot, one row per input row.

    Returns doc_id, size (UTF-8 bytes plus 8; null text has none), text_crc32 (unsigned), law
    ('rows': shard counts at most one apart), shard, slot, grown_shard (null), source. Texts never leave the map stage.
    """
    narrow = documents.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("source"),
    )
    placed = stratified_shards(narrow, n_shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source",
    )

"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import WIDTH, shingle_sets

K = 128
#: Bytes kept of each hash, its leading ones: 48 bits keep the order and make chance meetings negligible.
BYTES = 6
SPACE = 1 << (8 * BYTES)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct 64-bit hashes, cut to their leading 48 bits."""
    return np.unique(hashes[:k] >> np.uint64(64 - 8 * BYTES))


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union, from the sketches of its parts: exact, commutative, associative, idempotent."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / SPACE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness; exact where the union has at most k shingles. Two empty sketches are alike (1), an empty and another are not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    new = np.concatenate([[True], both[1:] != both[:-1]])
    upto = int(np.searchsorted(np.cumsum(new), min(k, int(new.sum())), side="right"))
    union = min(k, int(new.sum()))
    return (upto - union) / union


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty a is wholly contained (1)."""
    if not len(a):
        return 1.0
    joint = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, joint / distinct(a, k))


def encode(a: np.ndarray) -> str:
    """URL-safe base64 of the big-endian values, ascending, so equal sketches are equal strings."""
    return base64.urlsafe_b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    """Inverse of ``encode``."""
    own = np.frombuffer(base64.urlsafe_b64decode(text), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(own), 8), np.uint8)
    wide[:, 8 - BYTES :] = own
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(documents: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint and estimated n_shingles of every row's whole text, one map stage without shuffle.

    Null text counts as empty and has the empty fingerprint ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(s, k) for s in shingle_sets(batch["text"], width)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(encode, own), pa.string()), pa.array([distinct(s, k) for s in own], pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merged(prints: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Fingerprint of the union of each group's parts, native: distinct 48-bit values, then the k smallest.

    ``prints`` has ``keys`` and ``fingerprint``. A group that holds any share of the rows is reduced
    on the map side first, in parts of the fingerprints' own hash, so at most k values for each part travel on.
    """
    width = 8 * BYTES // 6
    parts = prints.filter(F.length("fingerprint") > 0).withColumn("__part", F.pmod(F.xxhash64("fingerprint"), F.lit(64)))
    values = parts.select(*keys, "__part", F.explode(F.expr(f"transform(sequence(0, length(fingerprint) div {width} - 1), i -> cast(conv(hex(unbase64(translate(substr(fingerprint, i * {width} + 1, {width}), '-_', '+/'))), 16, 10) as bigint))")).alias("v"))
    some = values.groupBy(*keys, "__part").agg(F.slice(F.array_sort(F.collect_set("v")), 1, k).alias("vs"))
    whole = some.groupBy(*keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))), 1, k).alias("vs"))
    coded = F.expr(f"array_join(transform(vs, v -> translate(base64(unhex(lpad(hex(v), {2 * BYTES}, '0'))), '+/', '-_')), '')")
    return whole.select(*keys, coded.alias("fingerprint"))


#: Ranges of doc_id for each shuffle partition, at most: so their bounds, which are broadcast, grow with the cluster's setting and not with the table.
RANGES = 64


def _cuts(ids: DataFrame, parts: int) -> list[int]:
    found = ids.filter(F.col("doc_id").isNotNull()).stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return sorted({int(x) for x in found or []})


def edited_fingerprints(documents: DataFrame, k: int = K, rows_per_range: int = 2000) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the
    next document in descending doc_id; after the last comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and n_shingles (estimate), one row per input row. Null text
    counts as empty; null doc_ids come last; rows with equal doc_id follow each other by text hash.

    Texts travel once, to ranges of doc_id of about ``rows_per_range`` rows; of each range only its
    first document goes a second time, to the range before it. Only the ranges' bounds pass the driver.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark, ids = docs.sparkSession, docs.select("doc_id")
    n_rows = ids.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(_cuts(ids, max(1, min(n_rows // rows_per_range, RANGES * partitions))), dtype=np.int64)
    sent = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("long")
    def range_of(doc_id: pa.Array) -> pa.Array:
        """0 is the range of the largest ids; null ids have the last."""
        held = sent.value
        at = len(held) - np.searchsorted(held, np.asarray(doc_id.fill_null(0)), side="right")
        return pa.array(np.where(np.asarray(doc_id.is_null()), len(held) + 1, at))

    tops = sorted(tuple(r) for r in ids.withColumn("r", range_of("doc_id")).groupBy("r").agg(F.max("doc_id")).collect())
    before = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}
    known = np.array(sorted(x for x in before if x is not None), dtype=np.int64)
    goes = spark.sparkContext.broadcast((known, np.array([before[x] for x in known.tolist()], dtype=np.int64), before.get(None, -1)))

    @F.arrow_udf("long")
    def copied_to(doc_id: pa.Array) -> pa.Array:
        """The range that needs this row as its last neighbour, else -1."""
        keys, to, of_null = goes.value
        if not len(keys):
            return pa.array(np.full(len(doc_id), of_null))
        own = np.asarray(doc_id.fill_null(0))
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return pa.array(np.where(np.asarray(doc_id.is_null()), of_null, np.where(keys[at] == own, to[at], -1)))

    placed = docs.withColumns({"__own": range_of("doc_id"), "__also": copied_to("doc_id")})
    here = F.struct(F.col("__own").alias("r"), F.lit(False).alias("halo"))
    there = F.struct(F.col("__also").alias("r"), F.lit(True).alias("halo"))
    placed = placed.withColumn("__to", F.explode(F.when(F.col("__also") >= 0, F.array(here, there)).otherwise(F.array(here))))
    parts = max(partitions, (len(cuts) + 1) // 8)
    rows = (
        placed.select(F.col("__to.r").alias("r"), F.col("__to.halo").alias("halo"), "doc_id", "text")
        .repartition(parts, "r")
        .sortWithinPartitions("r", "halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

        def judged(rows: list[tuple[int | None, str, np.ndarray, str, np.ndarray]]) -> pa.RecordBatch:
            texts = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, _, n, _ in rows]
            after = [sketch(s, k) for s in shingle_sets(pa.array(texts, pa.large_string()))]
            shas = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            cells = [
                [r[0] for r in rows], [len(r[1]) for r in rows], shas, [encode(r[2]) for r in rows], [encode(a) for a in after],
                [resemblance(r[2], a, k) for r, a in zip(rows, after)], [resemblance(r[2], r[4], k) for r in rows], [distinct(r[2], k) for r in rows],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names)

        last = None  # (range, doc_id, text, sketch), waiting for its neighbour
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(at, 1000), []
                own = [sketch(s, k) for s in shingle_sets(batch["text"])]
                for r, halo, doc, text, s in zip(batch["r"].to_pylist(), batch["halo"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), own):
                    if last is not None and last[0] == r:
                        out.append((last[1], last[2], last[3], text, s))
                        last = None
                    if not halo:
                        last = (r, doc, text, s)
                if out:
                    yield judged(out)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double")

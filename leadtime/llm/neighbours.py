"""Approximate nearest neighbours: multi-index hashing of learned binary codes, reranked on the vectors.

Codes are signs of a rotation learned so that they lie close to the data (iterative quantisation). A code is split in substrings and each is
indexed. If two codes differ in at most r bits, one of their m substrings differs in at most floor(r / m): so probing every
bucket of each index within that distance meets every code within r. Candidates are then ranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that a part of an index is to have, and most leading bits of a substring by which an index is cut in parts; larger parts are salted.
PART_ROWS, PART_BITS = 20_000, 8


@dataclass(frozen=True)
class Codebook:
    """Mean, projection and substring bounds of the codes; ``norm`` is the longest vector's, ``radius`` the bits probed."""

    mean: np.ndarray
    projection: np.ndarray
    norm: float
    radius: int
    bounds: tuple[int, ...]

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """uint64 code of each row. Rows get one more dimension so that all are of equal length and the angle to a query orders inner products."""
        x = vectors / self.norm
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
        if query:
            x = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
        bits = (np.concatenate([x, rest[:, None]], 1) - self.mean) @ self.projection > 0
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)

    def substring(self, codes: np.ndarray, j: int) -> np.ndarray:
        """Bits bounds[j] to bounds[j + 1] of each code."""
        return (codes >> np.uint64(self.bounds[j])) & np.uint64((1 << (self.bounds[j + 1] - self.bounds[j])) - 1)


def learn(vectors: np.ndarray, norm: float, k: int = 20, recall: float = 0.97, substrings: int = 4, rounds: int = 40, seed: int = 3) -> Codebook:
    """Rotation by iterative quantisation, and the radius that holds ``recall`` of the sample's own k nearest neighbours.

    Neighbours within all rows are nearer than within a sample, so the radius is on the safe side.
    """
    x = vectors / norm
    x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], 1)
    mean = x.mean(0)
    z = x - mean
    bits = min(64, vectors.shape[1])
    main = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :bits]
    p = z @ main
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
        turn = (u @ v).T
    m = min(substrings, bits)
    book = Codebook(mean, main @ turn, norm, bits, tuple(round(i * bits / m) for i in range(m + 1)))
    asked = np.arange(min(400, len(vectors)))
    near = vectors[asked] @ vectors.T
    near[asked, asked] = -np.inf
    best = np.argpartition(-near, min(k, len(vectors) - 1) - 1, axis=1)[:, :k] if len(vectors) > 1 else np.zeros((len(asked), 0), int)
    codes, own = book.codes(vectors), book.codes(vectors[asked], query=True)
    far = np.bitwise_count(own[:, None] ^ codes[best])
    radius = int(np.quantile(far, recall)) + 1 if far.size else bits
    return Codebook(mean, main @ turn, norm, min(radius, bits), book.bounds)


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    v = vector.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def _coded(rows: DataFrame, book: Codebook, query: bool) -> DataFrame:
    """(vec_id, vector, code) of rows or of queries."""
    sent = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = sent.value.codes(_matrix(batch["vector"], batch.num_rows), query).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vector"], pa.array(code)], ["vec_id", "vector", "code"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("vec_id", "vector").mapInArrow(run, f"vec_id long, vector {kind}, code long")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _top(code: Column, book: Codebook, j: int, bits: int) -> Column:
    """The leading ``bits`` of substring j of a code."""
    low, high = book.bounds[j], book.bounds[j + 1]
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")).cast("long") if bits >= high - low else F.shiftrightunsigned(code, high - bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _search(rows: DataFrame, queries: DataFrame, book: Codebook, k: int, radius: int) -> DataFrame:
    """(query_id, vec_id, score): of each part of the index the k best of every query's candidates within ``radius``. ``rows`` and ``queries``: vec_id, vector, code.

    An index of a substring is cut in parts by the substring's leading bits. A query goes to those parts alone whose bits differ from its own in no more than
    the substring may, probes the buckets there that are near enough, and reads what these hold. A part that has too many rows, as when many vectors
    are alike, is salted; its queries go to all of its shares.
    """
    spark = rows.sparkSession
    m, n_rows = len(book.bounds) - 1, rows.count()
    sent, reach = spark.sparkContext.broadcast(book), radius // m
    bits = max(0, min(PART_BITS, *(b - a for a, b in zip(book.bounds, book.bounds[1:])), (n_rows // PART_ROWS).bit_length()))
    tops = F.posexplode(F.array(*[_top(F.col("code"), book, j, bits) for j in range(m)])).alias("j", "top")
    indexed, asked = rows.select("vec_id", "vector", "code", tops), queries.select("vec_id", "vector", "code", tops)
    sizes = indexed.groupBy("j", "top").count().collect()  # at most m * 2**PART_BITS
    shares = [(r["j"], r["top"], -(-r["count"] // (2 * PART_ROWS))) for r in sizes]
    starts = np.concatenate([[0], np.cumsum([n for *_, n in shares])]).tolist()
    parts = spark.createDataFrame([(j, top, n, first) for (j, top, n), first in zip(shares, starts)], "pj int, ptop long, shares int, first long")
    indexed = indexed.join(F.broadcast(parts), (F.col("j") == F.col("pj")) & (F.col("top") == F.col("ptop")))
    indexed = indexed.select(F.lit(0).alias("kind"), "vec_id", "vector", "code", "j", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shares"))).alias("part"))
    near = F.bit_count(F.col("top").bitwiseXOR(F.col("ptop"))) <= reach
    asked = asked.join(F.broadcast(parts), (F.col("j") == F.col("pj")) & near)
    asked = asked.select(F.lit(1).alias("kind"), "vec_id", "vector", "code", "j", F.explode(F.expr("sequence(first, first + shares - 1)")).alias("part"))
    n_parts = min(max(1, starts[-1]), max(int(spark.conf.get("spark.sql.shuffle.partitions")), starts[-1] // 4))
    work = indexed.unionByName(asked).repartition(n_parts, "part").sortWithinPartitions("part", "kind", "vec_id")

    def answered(j: int, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, query_vectors: np.ndarray, query_codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = sent.value
        own = held.substring(codes, j)
        order = np.argsort(own, kind="stable")
        ids, vectors, codes, own = ids[order], vectors[order], codes[order], own[order]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        buckets, size = own[start], np.diff(np.append(start, len(own)))
        values = held.substring(query_codes, j)
        out: list[tuple[np.ndarray, ...]] = []
        for q in range(len(query_ids)):
            hit = np.flatnonzero(np.bitwise_count(buckets ^ values[q]) <= reach)  # the buckets probed
            width = size[hit]
            place = np.repeat(start[hit] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            differ = codes[place] ^ query_codes[q]
            keep = np.bitwise_count(differ) <= radius
            for i in range(j):  # another index has it already
                keep &= np.bitwise_count(held.substring(differ, i)) > reach
            place = place[keep]
            place = place[ids[place] != query_ids[q]]
            if not len(place):
                continue
            if len(place) > 4 * k:
                rough = vectors[place] @ query_vectors[q]
                place = place[rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + np.abs(rough).max())]
            score = (vectors[place] * query_vectors[q]).sum(1)
            top = np.lexsort((ids[place], -score))[:k]
            out.append((np.full(len(top), query_ids[q]), ids[place][top], score[top]))
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: list | None = None  # part, substring, ids, vectors, codes of the rows read last
        held: list[pa.RecordBatch] = []
        built = None

        def read(some: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, codes = (np.concatenate([b[c].to_numpy() for b in some]) for c in ("vec_id", "code"))
            return ids, np.concatenate([_matrix(b["vector"], b.num_rows) for b in some]), codes.view(np.uint64)

        for batch in batches:
            part, kind = batch["part"].to_numpy(), batch["kind"].to_numpy()
            edge = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(part)]):
                if lo == hi:
                    continue
                if index is None or index[0] != part[lo]:
                    index, held, built = [int(part[lo]), int(batch["j"][lo].as_py())], [], None
                if kind[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                elif held:  # queries come after the part's rows, in batches
                    built = built or read(held)
                    yield from answered(index[1], *built, *read([batch.slice(lo, hi - lo)]))

    return work.select("part", "kind", "j", "vec_id", "vector", "code").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(embeddings: DataFrame, query: Column, k: int = 20, sample_rows: int = 10_000, recall: float = 0.97) -> DataFrame:
    """The k nearest rows, by inner product in double precision, of every row of ``embeddings`` (vec_id, embedding) that ``query`` picks.

    Returns query_id, rank from 1, vec_id, score; nearest first, ties to the smaller vec_id, the query's own id left out. Every row is
    indexed; only rotation and radius come from a sample of at most ``sample_rows`` rows, those with the smallest hash.
    A query with fewer than k candidates in the radius is searched again in all rows, so no answer is short of what there is. Vectors that
    are null, zero or not finite take no part, nor do null ids, nor vectors of another length than most, which have no inner product with
    them; of rows repeated under one vec_id the smallest vector counts, since an answer names its row by vec_id. Equal scores go to the smaller
    vec_id. Other columns are not read. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    sound = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    sound = materialize(sound.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    sizes = sound.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = sound.filter(F.size("vector") == sizes["d"])
    queries = rows.filter(query)
    norm = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()["vector"].combine_chunks()
    drawn = drawn.chunk(0) if isinstance(drawn, pa.ChunkedArray) else drawn
    book = learn(drawn.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, sizes["d"]), norm, k, recall)
    rows, queries = materialize(_coded(rows, book, False), "codes"), materialize(_coded(queries, book, True), "query-codes")
    found = materialize(_search(rows, queries, book, k, book.radius), "found")
    wanted = min(k, sizes["count"] - 1)
    enough = found.groupBy("query_id").count().filter(F.col("count") >= wanted)
    short = materialize(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"), "short")
    if wanted and not short.isEmpty():
        again = _search(rows, short, book, k, len(book.mean) + 64)
        found = found.join(enough.select("query_id"), "query_id", "left_semi").unionByName(again)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

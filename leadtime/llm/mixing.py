"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ranked, scanned

#: Sources scheduled one by one. If there are more, the smallest ones share a class, whose weight is the sum of theirs.
SOURCES = 256
#: Slots folded by one SQL expression.
SEGMENT = 2_000
#: Most (source, hash bucket) counts of the ordering, about 60 bytes each.
BUCKETS = 1 << 18


def period(spark: SparkSession, weights: list[int]) -> list[int]:
    """Which source has each slot of one period of sum(weights) slots, as a SQL fold over the slots, SEGMENT at a time.

    Block k of a source of weight a in a period of A slots is released at floor(k A / a) and due by ceil((k + 1) A / a). Each
    slot goes to the released block due first, ties to the earlier source. One block fits a slot and the rates
    add up to one, so every deadline is met and each source is less than one block from its share at every slot.
    """
    total, given, order = sum(weights), [0] * len(weights), []
    w = "array(" + ", ".join(f"{x}L" for x in weights) + ")"
    due = f"(element_at(s.k, cast(i + 1 as int)) + 1) * {total}L"
    ready = f"filter(transform({w}, (a, i) -> IF(element_at(s.k, cast(i + 1 as int)) * {total}L div a <= t, named_struct('due', ({due} + a - 1) div a, 'i', i), NULL)), x -> x IS NOT NULL)"
    step = f"transform(array(array_min({ready}).i), p -> named_struct('k', transform(s.k, (v, i) -> IF(i = p, v + 1, v)), 'o', concat(s.o, array(p))))[0]"
    for at in range(0, total, SEGMENT):
        k = "array(" + ", ".join(f"{x}L" for x in given) + ")"
        fold = f"aggregate(sequence({at}L, {min(at + SEGMENT, total) - 1}L), named_struct('k', {k}, 'o', cast(array() as array<int>)), (s, t) -> {step})"
        found = spark.sql(f"SELECT {fold} AS s").first()["s"]
        given, order = list(found["k"]), order + list(found["o"])
    return order


def schedule(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple]:
    """Runs (source, first block, end block, weight, period, first slot, offsets) that place every block.

    When a source has given its last block, the others go on at their weights among themselves, in a new phase. Weights count by their
    ratio: those of a phase are divided by their greatest common divisor.
    """
    left = {s: n for s, n in sorted(blocks.items()) if n}
    given = dict.fromkeys(left, 0)
    runs, slot, known = [], 0, {}
    while left:
        active = sorted(left, key=lambda s: (-weights[s], s))
        unit = gcd(*(weights[s] for s in active))
        rate = {s: weights[s] // unit for s in active}
        rates = tuple(rate.values())
        total = sum(rates)
        order = known[rates] if rates in known else known.setdefault(rates, period(spark, list(rates)))
        offsets: dict[str, list[int]] = {s: [] for s in active}
        for at, i in enumerate(order):
            offsets[active[i]].append(at)
        last = {s: (left[s] - 1) // rate[s] * total + offsets[s][(left[s] - 1) % rate[s]] for s in active}
        length = min(last.values()) + 1
        for s in active:
            n = length // total * rate[s] + bisect_left(offsets[s], length % total)
            if n:
                runs.append((s, given[s], given[s] + n, rate[s], total, slot, offsets[s]))
            given[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot += length
    return runs


def _blocks_before(runs: list[tuple], slot: int) -> dict[str, int]:
    """How many blocks of each source lie in slots before ``slot``."""
    found = {s: 0 for s, *_ in runs}
    for s, low, high, a, total, start, offsets in runs:
        t = slot - start
        if t > 0:
            found[s] = max(found[s], low + min(high - low, t // total * a + bisect_left(offsets, t % total)))
    return found


def _tag(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))


class _Plan:
    """Classes of sources, their rows and the schedule of their blocks. ``rows``: a column of sources."""

    def __init__(self, rows: DataFrame, source: str, weights: Mapping[str, int], default_weight: int, block_rows: int) -> None:
        if block_rows < 1 or default_weight < 1 or any(w < 1 for w in weights.values()):
            raise ValueError("block_rows and weights must be positive")
        tag = _tag(source)
        self.own = None
        counts = rows.groupBy(tag.alias("t")).agg(F.count(F.lit(1)).alias("n"))
        named = {("null" if k is None else f"={k}"): int(w) for k, w in weights.items()}
        largest = counts.orderBy(F.col("n").desc(), "t").limit(SOURCES + 1).collect()
        self.sizes, self.weights = {r["t"]: r["n"] for r in largest}, {r["t"]: named.get(r["t"], default_weight) for r in largest}
        if len(largest) > SOURCES:
            own = [r["t"] for r in largest[: SOURCES - 1]]
            rest = counts.filter(~F.col("t").isin(own))
            given = [t for t in named if t not in own]
            sums = rest.agg(F.sum("n"), F.sum(F.when(~F.col("t").isin(given) if given else F.lit(True), default_weight).otherwise(0))).first()
            there = {r["t"] for r in rest.filter(F.col("t").isin(given)).collect()} if given else set()
            self.sizes = {t: self.sizes[t] for t in own} | {"rest": sums[0]}
            self.weights = {t: self.weights[t] for t in own} | {"rest": sums[1] + sum(named[t] for t in there)}
            self.own = own
        self.runs = schedule(rows.sparkSession, {s: -(-n // block_rows) for s, n in self.sizes.items()}, self.weights)
        self.block_rows, self.slots = block_rows, sum(-(-n // block_rows) for n in self.sizes.values())

    def tag_of(self, source: str) -> Column:
        """The class of each row by its column of sources."""
        tag = _tag(source)
        return tag if self.own is None else F.when(tag.isin(self.own), tag).otherwise("rest")

    def placed(self, rows: DataFrame, rank: str) -> DataFrame:
        """``rows`` (__mix_tag and a rank within it) plus __mix_block, __mix_slot and __mix_place."""
        plan = rows.sparkSession.createDataFrame(self.runs, "__mix_t string, __mix_low long, __mix_high long, __mix_a long, __mix_total long, __mix_start long, __mix_offsets array<int>")
        own = rows.withColumn("__mix_block", F.expr(f"{rank} div {self.block_rows}"))
        j = own.join(F.broadcast(plan), (F.col("__mix_tag") == F.col("__mix_t")) & (F.col("__mix_block") >= F.col("__mix_low")) & (F.col("__mix_block") < F.col("__mix_high")))
        j = j.withColumn("__mix_slot", F.expr("__mix_start + (__mix_block - __mix_low) div __mix_a * __mix_total + __mix_offsets[cast((__mix_block - __mix_low) % __mix_a as int)]"))
        return j.withColumn("__mix_place", F.expr(f"__mix_slot * {self.block_rows} + {rank} % {self.block_rows}"))


def _spread(rows: DataFrame, keys: tuple[str, ...], seed: int) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.lit(seed))


def mixed(rows: DataFrame, weights: Mapping[str, int], default_weight: int = 1, block_rows: int = 64, seed: int = 29, keys: tuple[str, ...] = ("doc_id",), source: str = "source") -> DataFrame:
    """``rows`` plus block, slot and place: the order in which sources interleave to their target weights.

    Rows are shuffled within their source by a seeded hash of ``keys`` and cut in blocks of ``block_rows``; the last block of a source may be
    smaller. Blocks take slots by ``schedule``; ``place`` = slot * block_rows + position in the block orders the rows. At every
    slot of a phase each source is less than one block from its share of the phase. No row is lost or repeated: sources that are
    larger than their weight simply last longer. A null source is a source of its own, with ``default_weight``
    unless ``weights`` has None; equal rows take neighbouring places; an empty table gives no rows. Columns of ``rows`` that are named
    block, slot or place come out as block_before, slot_before and place_before; names that begin with __mix_ are reserved.

    Beyond SOURCES sources the smallest ones are scheduled as one class with the sum of their weights, in which their rows lie in
    the seeded order. Positions are two-level ranks (``common.ranked``), so a source may hold any share of the rows; what passes the
    driver is a row count a class. ``rows`` should be narrow: see ``ordered`` for rows with texts. A frame that is not a plain scan is written first.
    """
    rows = scanned(rows)
    own = [F.col(f"`{c}`").alias(f"{c}_before" if c in ("block", "slot", "place") else c) for c in rows.columns]
    plan = _Plan(rows, source, weights, default_weight, block_rows)
    tagged = rows.withColumn("__mix_tag", plan.tag_of(source))
    placed = plan.placed(ranked(tagged, ["__mix_tag"], [F.col(f"`{k}`") for k in keys], _spread(rows, keys, seed), "__mix_rank"), "__mix_rank")
    return placed.select(*own, F.col("__mix_block").alias("block"), F.col("__mix_slot").alias("slot"), F.col("__mix_place").alias("place"))


def ordered(rows: DataFrame, weights: Mapping[str, int], default_weight: int = 1, block_rows: int = 64, seed: int = 29, keys: tuple[str, ...] = ("doc_id", "text"), source: str = "source") -> DataFrame:
    """``rows``, all columns and no other, in the order of ``mixed``: the rows move once.

    The places are cut in as many ranges as there are shuffle partitions. What a range holds of a source is a range of its ranks, and so of its
    seeded hashes: these limits are found exactly on a table of hashes alone, from counts of (source, hash bucket) and a ranking of
    the buckets that hold a limit. Then each row goes to its range, and is ranked, placed and sorted there. Hashes are of ``keys``; only rows that
    agree in all of them tie, and such rows stay in one range, in any order. A frame that is not a plain scan is written first. Null, empty and repeated rows are rows like any others.
    """
    spark, rows = rows.sparkSession, scanned(rows)
    spread = _spread(rows, keys, seed).bitwiseXOR(F.lit(-(2**63)))  # signed order of it is unsigned order of the hash
    narrow = materialize(rows.select(F.col(f"`{source}`").alias("source"), spread.alias("h")), "mix-hashes")
    plan = _Plan(narrow, "source", weights, default_weight, block_rows)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), plan.slots))
    bits = max(1, min(30, (BUCKETS // max(1, len(plan.sizes))).bit_length() - 1, max(1, sum(plan.sizes.values()) // 20_000).bit_length()))
    tagged = narrow.select(plan.tag_of("source").alias("__mix_tag"), "h", F.shiftright("h", 64 - bits).alias("b"))
    counts = tagged.groupBy("__mix_tag", "b").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__mix_tag").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("off", before)
    limits = [(s, p, k * block_rows) for p in range(1, parts) for s, k in _blocks_before(plan.runs, p * plan.slots // parts).items()]
    cuts = spark.createDataFrame(limits, "t string, p int, r long")
    inside = counts.join(F.broadcast(cuts), (F.col("__mix_tag") == F.col("t")) & (F.col("r") >= F.col("off")) & (F.col("r") < F.col("off") + F.col("n"))).select("t", "p", F.col("b").alias("cb"), (F.col("r") - F.col("off")).alias("nth"))
    inside = materialize(inside, "mix-cuts")
    held = tagged.join(F.broadcast(inside.select("t", "cb").distinct()), (F.col("__mix_tag") == F.col("t")) & (F.col("b") == F.col("cb"))).select("t", "cb", "h")
    nth = held.withColumn("nth", F.row_number().over(Window.partitionBy("t", "cb").orderBy("h")) - 1)
    limit = materialize(nth.join(F.broadcast(inside), ["t", "cb", "nth"]).select("t", "p", "cb", "h"), "mix-limits")
    # of each bucket: how many ranges begin before it (a limit beyond a source's rows begins nowhere), and the hashes at which others begin in it
    begun = limit.groupBy("t", "cb").agg(F.sort_array(F.collect_list("h")).alias("__mix_hs"))
    none = F.coalesce(F.size("__mix_hs"), F.lit(0))
    base = F.sum(F.greatest(none, F.lit(0))).over(Window.partitionBy("__mix_tag").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    located = counts.join(F.broadcast(begun), (F.col("__mix_tag") == F.col("t")) & (F.col("b") == F.col("cb")), "left").select(F.col("__mix_tag").alias("__mix_k"), F.col("b").alias("__mix_c"), F.coalesce(base, F.lit(0)).alias("__mix_base"), "__mix_hs")
    located = materialize(located, "mix-buckets")
    same = (F.col("__mix_tag") == F.col("__mix_k")) & (F.col("__mix_b") == F.col("__mix_c"))

    def ranged(frame: DataFrame) -> DataFrame:
        """A frame of __mix_tag, __mix_h and more, with the range of each row."""
        range_ = F.expr("__mix_base + if(__mix_hs is null, 0, size(filter(__mix_hs, x -> x <= __mix_h)))")
        return frame.withColumn("__mix_b", F.shiftright("__mix_h", 64 - bits)).join(F.broadcast(located), same).withColumn("__mix_range", range_.cast("int")).drop("__mix_b", "__mix_k", "__mix_c", "__mix_base", "__mix_hs")

    starts = ranged(narrow.select(plan.tag_of("source").alias("__mix_tag"), F.col("h").alias("__mix_h"))).groupBy("__mix_tag", "__mix_range").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("__mix_tag").orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(starts.select(F.col("__mix_tag").alias("__mix_k"), F.col("__mix_range").alias("__mix_c"), F.coalesce(earlier, F.lit(0)).alias("__mix_first")), "mix-starts")
    moved = ranged(rows.withColumns({"__mix_tag": plan.tag_of(source), "__mix_h": spread})).repartitionByRange(parts, "__mix_range")
    place = F.row_number().over(Window.partitionBy("__mix_range", "__mix_tag").orderBy("__mix_h"))
    moved = moved.withColumn("__mix_n", place).join(F.broadcast(starts), (F.col("__mix_tag") == F.col("__mix_k")) & (F.col("__mix_range") == F.col("__mix_c")))
    moved = plan.placed(moved.withColumn("__mix_rank", F.expr("__mix_first + __mix_n - 1")), "__mix_rank")
    return moved.sortWithinPartitions("__mix_range", "__mix_place").select(*[F.col(f"`{c}`") for c in rows.columns])


def mix_documents(documents: DataFrame, weights: Mapping[str, int], default_weight: int = 1, block_rows: int = 64) -> DataFrame:
    """doc_id, source, block, slot, place of every document; texts are not read."""
    narrow = materialize(documents.select("doc_id", "source"), "mix-rows")
    return mixed(narrow, weights, default_weight, block_rows)

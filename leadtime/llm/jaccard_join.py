"""N-gram Jaccard join: documents linked by the likeness of their shingle sets, as a blocked sparse product.

The documents' sets are the rows of a sparse incidence matrix, n-grams its columns; the overlaps wanted are entries
of its product with its transpose. These facts bound the work, none of them loses a link.

* Equal sets are one row (class), whatever the number of copies.
* Two sets of sizes n <= m with likeness t or more overlap in at least c = t (n + m) / (1 + t) n-grams. In any common order of
  the n-grams they then meet among the first n - ceil(t n) + 1 of each, so the product is first taken over those
  leading columns only. The order puts the n-grams found often in some part of the corpus last (a statistic of all texts that only
  steers the work), so a passage that many documents share is no leading column of theirs. Pairs whose summed overlap cannot reach c
  any more are discarded.
* Columns of more than SHORT members are taken by themselves, when it is known how many such columns a set has among its leading ones. If
  these alone could make it link with a set of its size, its neighbours in size of that kind are joined in a chain. Other sets can meet
  through them only sets of certain sizes, and only such pairs are counted. Marked columns, the only ones
  that can hold a large share of all rows, are not even gathered: each of their members goes with a node that stands for the
  column. So candidates grow with the incidence, not with the square of a group.
* Candidate pairs and stars fall into connected groups. A group's whole sets travel once, as compressed texts, into one block, and the product
  is taken over all columns of the block; a pair links by its full overlap, and pairs already connected are not counted again. A group of
  more than BLOCK n-grams is cut in tiles, and each pair of tiles is a block.

Sets are of 64-bit hashes; a chance meeting of two n-grams is the one source of error (2**-64 a pair).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, tidy
from .components import connected_components
from .shingles import WIDTH, shingle_sets

#: Members of a column up to which all its pairs are taken.
SHORT = 64
#: Most n-grams marked as frequent; the most frequent ones of all that are.
MARKED = 1 << 19
PAIR = ["a", "b", "n", "m", "overlap"]
#: N-grams of a block, about 100 bytes each in a worker while they are multiplied.
BLOCK = 600_000


def set_id(hashes: np.ndarray) -> int:
    """63-bit digest of a set; equal sets are equal ids."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 1


def _leading(n, percent: int):
    """How many leading columns of a set of n can hold the first meeting."""
    return n - -(-percent * n // 100) + 1


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of sizes n and m: 100 i >= percent (n + m - i)."""
    return -((-percent * (n + m)) // (100 + percent))


def _sets(documents: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, text_hash, n, sid) of documents and, apart from them, (count, gram) of n-grams met at least twice in a task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n", "sid", "gram"]
        held, size, seen = [], 0, set()

        def often() -> pa.RecordBatch:
            grams = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate([new, [len(grams)]]))
            twice = count > 1
            k = int(twice.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(count[twice]), pa.nulls(k, pa.int64()), pa.array(grams[new[twice]].view(np.int64))], names)

        for batch in batches:
            n, ids = [], []
            for s in shingle_sets(batch["text"], width):
                n.append(len(s))
                ids.append(set_id(s))
                if len(s) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(len(n), pa.int64())], names)
            if size > 2_000_000:
                yield often()
                held, size, seen = [], 0, set()
        yield often()

    return documents.mapInArrow(run, "doc_id long, text_hash long, n long, sid long, gram long")


class _Order:
    """The common order of n-grams: marked ones last, else by hash."""

    def __init__(self, marked: np.ndarray) -> None:
        self.marked = np.sort(marked.view(np.uint64))
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.marked >> np.uint64(44)).astype(np.int64)] = True

    def leading(self, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k of a sorted set, those not marked and those that are."""
        maybe = np.flatnonzero(self.near[(s >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.marked):
            at = np.minimum(np.searchsorted(self.marked, s[maybe]), len(self.marked) - 1)
            last = np.zeros(len(s), bool)
            last[maybe] = self.marked[at] == s[maybe]
            rest = s[~last]
            return rest[:k], s[last][: max(0, k - len(rest))]
        return s[:k], s[:0]


def _incidence(documents: DataFrame, marked: np.ndarray, percent: int, width: int) -> DataFrame:
    """Leading columns of every distinct set of a task: gram, sid, n; for marked ones n is 0 and gram the column's own node, a negative number."""
    sent = documents.sparkSession.sparkContext.broadcast(marked)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = _Order(sent.value), set()
        for batch in batches:
            grams, sids, ns = [], [], []
            for s in shingle_sets(batch["text"], width):
                n, sid = len(s), set_id(s)
                if not n or sid in seen:
                    continue
                seen.add(sid)
                own, common = order.leading(s, _leading(n, percent))
                grams += [own.view(np.int64), -1 - (common >> np.uint64(1)).view(np.int64)]
                sids.append(np.full(len(own) + len(common), sid, np.int64))
                ns += [np.full(len(own), n, np.int32), np.zeros(len(common), np.int32)]
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(ns))], ["gram", "sid", "n"])

    return documents.select("text").mapInArrow(run, "gram long, sid long, n int")


def _met(gram: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows sorted by column that share a column of at most SHORT members and whose sizes allow a link."""
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = np.arange(len(gram))
    for step in range(1, SHORT + 1):
        live = live[live + step < len(gram)]
        live = live[gram[live] == gram[live + step]]
        if not len(live):
            break
        i, j = live, live + step
        can = np.minimum(n[i], n[j]) >= _needed(n[i].astype(np.int64), n[j].astype(np.int64), percent)
        found_a.append(i[can])
        found_b.append(j[can])
    return np.concatenate(found_a), np.concatenate(found_b)


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller id first, and how often each is there."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, np.int64)
    return low[new], high[new], np.diff(np.concatenate([new, [len(low)]]))


def _blocked(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """The product over leading columns, a block of columns in each task.

    Kind 0 are pairs (a, b) with their sizes and the overlap counted in this block's short columns, kind 1 the rows (column, set, size) of long
    columns, kind 2 the edges of marked columns.
    """
    names = ["kind", "a", "b", "n", "m", "overlap"]

    def batch(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, overlap: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n), pa.array(m), pa.array(overlap.astype(np.int32))], names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        gram, sid, n = (table[c].to_numpy() for c in ("gram", "sid", "n"))
        center, member, _ = _counted(gram[n == 0], sid[n == 0])
        yield batch(2, member, center, *[np.zeros(len(center), np.int32)] * 3)
        gram, sid, n = _columns(gram[n > 0], sid[n > 0], n[n > 0])
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)])
        size = np.diff(np.concatenate([first, [len(gram)]]))
        of = np.repeat(size, size)
        some, long = (of > 1) & (of <= SHORT), of > SHORT
        s, k = sid[some], n[some]
        i, j = _met(gram[some], k, percent)
        a, b, count = _counted(s[i], s[j])
        ids, at = np.unique(s, return_index=True)
        yield batch(0, a, b, k[at][np.searchsorted(ids, a)], k[at][np.searchsorted(ids, b)], count)
        yield batch(1, gram[long], sid[long], n[long], n[long], np.zeros(int(long.sum())))

    return rows.repartition(parts, F.when(F.col("n") > 0, F.col("gram")).otherwise(F.col("sid"))).mapInArrow(run, "kind int, a long, b long, n int, m int, overlap int")


def _columns(gram: np.ndarray, sid: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Incidence rows sorted by column, size and set, each once."""
    order = np.lexsort((sid, n, gram))
    gram, sid, n, *more = (x[order] for x in (gram, sid, n, *more))
    keep = np.concatenate([[True], (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])])[: len(gram)]
    return tuple(x[keep] for x in (gram, sid, n, *more))


def _least(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Leading columns that sets of sizes n <= m must share at least: what they need less what can lie beyond the leading ones of the larger."""
    return _needed(n, m, percent) - (-(-percent * m // 100) - 1)


def _long_edges(long: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) with sizes and the overlap in long columns, of those whose long columns can suffice; overlap 0 marks edges of chains. ``long``: gram, sid, n, c.

    c is the number of a set's long leading columns. Sets with enough of them for a partner of their own size are chained in each column; the
    others are paired with the sets of a column whose sizes come into question, a narrow range.
    """
    t = percent / 100
    r = t / (1 + t)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        gram, sid, n, c = _columns(*(table[x].to_numpy().astype(np.int64) for x in ("gram", "sid", "n", "c")))
        dense = c >= _least(n, n, percent)
        at = np.flatnonzero(dense)
        linked = (gram[at[1:]] == gram[at[:-1]]) & (100 * n[at[:-1]] >= percent * n[at[1:]])
        a, b, _ = _counted(sid[at[:-1]][linked], sid[at[1:]][linked])
        none = np.zeros(len(a), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(none), pa.array(none), pa.array(none)], PAIR)
        # rows are in order of (column, size): ranges of sizes are ranges of rows
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        column = np.cumsum(np.concatenate([[0], (gram[1:] != gram[:-1]).astype(np.int64)]))
        scale = int(n.max()) + 2
        place = column * scale + n
        own = np.flatnonzero(~dense)
        most = scale - 1
        for up in (True, False):
            if up:  # partners of the same size or larger
                low = np.maximum(n[own], np.ceil((r * n[own] - c[own] - 1) / (t - r)).astype(np.int64) - 2)
                high = np.minimum(100 * n[own] // percent, most)
            else:  # smaller partners, of the dense kind
                low = -(-percent * n[own] // 100)
                high = np.minimum(n[own], np.floor((c[own] + 1 + (t - r) * n[own]) / r).astype(np.int64) + 2)
            begin = np.searchsorted(place, column[own] * scale + np.clip(low, 0, most), side="left")
            end = np.searchsorted(place, column[own] * scale + np.clip(high, 0, most), side="right")
            width = np.maximum(0, end - begin)
            step = np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()) + 1, 2_000_000))
            for lo, hi in zip(step, [*step[1:], len(own)]):
                w = width[lo:hi]
                if not w.sum():
                    continue
                i = np.repeat(own[lo:hi], w)
                j = np.repeat(begin[lo:hi] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
                keep = (j > i) if up else (dense[j] & (i != j))
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                keep &= (100 * small >= percent * large) & (_least(small, large, percent) <= np.minimum(c[i], c[j]))
                i, j = i[keep], j[keep]
                if up:  # same size, both counted once; a dense partner of the same size belongs to the other pass
                    both = ~(dense[j] & (n[i] == n[j]))
                    i, j = i[both], j[both]
                a, b, count = _counted(sid[i], sid[j])
                ids, where = np.unique(sid, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n[where][np.searchsorted(ids, a)].astype(np.int32)), pa.array(n[where][np.searchsorted(ids, b)].astype(np.int32)), pa.array(count.astype(np.int32))], PAIR)

    return long.repartition(parts, "gram").mapInArrow(run, "a long, b long, n int, m int, overlap int")


def _candidates(met: DataFrame, percent: int, parts: int) -> DataFrame:
    """Edges (a, b): chains, members of marked columns, and the pairs whose overlap, summed over all column blocks, can still reach what their sizes need.

    Common n-grams are leading in both sets, or lie beyond the
    leading ones of the set whose leading ones end first: at most n - leading(n) of them. Leading ones are counted in short columns, and in long ones
    where these can suffice; pairs with common short columns are given all the long columns that both could share besides.
    """
    short = met.filter("kind = 0").select("a", "b", "n", "m", "overlap", F.lit(0).alias("long"))
    marked = met.filter("kind = 2").select("a", "b")
    rows = met.filter("kind = 1").select(F.col("a").alias("gram"), F.col("b").alias("sid"), "n")
    columns = rows.groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    edges = materialize(_long_edges(rows.join(columns, "sid"), percent, parts), "long-edges")
    counted = edges.filter("overlap > 0").select("a", "b", "n", "m", F.lit(0).alias("overlap"), F.col("overlap").alias("long"))
    pairs = short.unionByName(counted).groupBy("a", "b").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("overlap").alias("overlap"), F.sum("long").alias("long"))
    pairs = pairs.join(columns.select(F.col("sid").alias("a"), F.col("c").alias("ca")), "a", "left").join(columns.select(F.col("sid").alias("b"), F.col("c").alias("cb")), "b", "left")
    most = "overlap + if(overlap > 0, greatest(long, least(coalesce(ca, 0), coalesce(cb, 0))), long)"
    beyond = lambda c: f"(({percent} * {c} + 99) div 100 - 1)"
    reach = F.expr(f"{most} + greatest({beyond('n')}, {beyond('m')}) >= ({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    return pairs.filter(reach).select("a", "b").unionByName(edges.filter("overlap = 0").select("a", "b").distinct()).unionByName(marked)


def _marked_ids(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2**bits bits, in 16 parts made on the executors: bit h & (2**bits - 1) of every id."""
    part_bits = bits - 4

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            s = batch["s"].to_numpy()
            for slot in np.unique(s & 15).tolist():
                mine = own.setdefault(slot, np.zeros(1 << part_bits, bool))
                mine[(s[(s & 15) == slot] >> 4) & ((1 << part_bits) - 1)] = True
        for slot, mine in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.packbits(mine).tobytes()], pa.binary())], ["slot", "bits"])

    flat = np.zeros((16, 1 << part_bits), bool)
    for slot, packed in ids.repartition(16, F.col("s").bitwiseAND(F.lit(15))).mapInArrow(run, "slot int, bits binary").collect():
        flat[slot] |= np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    return np.packbits(flat, axis=None)


def _involved(documents: DataFrame, ids: DataFrame, n_ids: int, width: int) -> DataFrame:
    """(sid, packed) of the sets whose ids are in ``ids`` (s), once each, and of few others; packed is a text that has the set.

    A bit filter, 16 bits an id and 2**28 bits (32 MB) at most, picks them while the texts are read; beyond that size more
    sets pass than are needed, and none is lost.
    """
    bits = min(28, max(16, (16 * n_ids).bit_length()))
    sent = documents.sparkSession.sparkContext.broadcast(_marked_ids(ids, bits))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, part_bits, pack = sent.value, set(), bits - 4, zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            sids, packed, texts = [], [], batch["text"]
            for at, s in enumerate(shingle_sets(texts, width)):
                sid = set_id(s)
                bit = ((sid & 15) << part_bits) | ((sid >> 4) & ((1 << part_bits) - 1))
                if len(s) and (int(held[bit >> 3]) >> (7 - (bit & 7))) & 1 and sid not in seen:
                    seen.add(sid)
                    sids.append(sid)
                    packed.append(pack.compress(texts[at].as_py().encode()))
            if sids:
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(packed, pa.binary())], ["sid", "packed"])

    return documents.select("text").mapInArrow(run, "sid long, packed binary").dropDuplicates(["sid"])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    return int((long[at] == short).sum())


class _Block:
    """The whole sets of a block, of one tile or of two, and which of them are connected so far."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], tiles: list[int], percent: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets, self.percent = [ids[i] for i in order], [sets[i] for i in order], percent
        self.tile = np.array([tiles[i] for i in order])
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.label = np.arange(len(ids))
        self.links: list[tuple[int, int]] = []

    def linked(self, i: int, j: int) -> None:
        self.links.append((min(self.ids[i], self.ids[j]), max(self.ids[i], self.ids[j])))

    def neighbours(self) -> None:
        """Links to the next set by least n-gram, by greatest and by size: near copies are mostly connected after it."""
        lows, highs = np.array([s[0] for s in self.sets]), np.array([s[-1] for s in self.sets])
        every, root = np.arange(len(self.ids)), list(range(len(self.ids)))

        def top(v: int) -> int:
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        for order in (np.lexsort((every, lows)), np.lexsort((every, highs)), every):
            for i, j in zip(order[:-1].tolist(), order[1:].tolist()):
                n, m = len(self.sets[i]), len(self.sets[j])
                if 100 * min(n, m) >= self.percent * max(n, m) and (p := top(i)) != (q := top(j)):
                    both = _overlap(self.sets[i], self.sets[j])
                    if 100 * both >= self.percent * (n + m - both):
                        root[max(p, q)] = min(p, q)
                        self.linked(i, j)
        self.label = np.array([top(i) for i in range(len(root))])

    def product(self) -> None:
        """Overlaps of every set outside the largest connected part with all sets not connected with it, by accumulating over all columns."""
        cross = len(np.unique(self.tile)) > 1
        outside = np.flatnonzero(self.tile == self.tile[0] if cross else self.label != np.bincount(self.label).argmax())
        if not len(outside):
            return
        grams, row = np.concatenate(self.sets), np.repeat(np.arange(len(self.ids), dtype=np.int32), self.n)
        order = np.argsort(grams, kind="stable")
        grams, row = grams[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        size = np.diff(np.concatenate([first, [len(grams)]]))
        column = np.empty(len(grams), np.int64)
        column[order] = np.repeat(np.arange(len(first)), size)
        begin = np.concatenate([[0], np.cumsum(self.n)])
        for i in outside.tolist():
            cols = column[begin[i] : begin[i + 1]]
            cols = cols[size[cols] > 1]
            if not len(cols):
                continue
            start, width = first[cols], size[cols]
            at = np.repeat(start - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            both = np.bincount(row[at], minlength=len(self.ids))
            hit = 100 * both >= self.percent * (self.n + self.n[i] - both)
            hit &= self.label != self.label[i]
            if cross:
                hit &= self.tile != self.tile[i]
            for j in np.flatnonzero(hit).tolist():
                p, q = self.label[i], self.label[j]
                if p != q:
                    self.label[self.label == max(p, q)] = min(p, q)
                    self.linked(i, j)


def _linked(groups: DataFrame, texts: DataFrame, percent: int, width: int, parts: int) -> DataFrame:
    """A spanning forest (a, b) of the links within each group; ``groups``: sid, group, n."""
    tiles = groups.groupBy("group").agg(F.expr(f"sum(n) div {BLOCK} + 1").alias("tiles"))
    placed = groups.join(tiles, "group").withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    placed = placed.select("sid", "tile", F.xxhash64("group", F.least("tile", "other"), F.greatest("tile", "other")).alias("block"))
    work = placed.join(texts, "sid").repartition(parts, "block").sortWithinPartitions("block", "sid")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held, block = zstandard.ZstdDecompressor(), ([], [], []), None

        def done() -> list[tuple[int, int]]:
            if len(held[0]) < 2:
                return []
            b = _Block(*held, percent)
            if len(np.unique(b.tile)) == 1:
                b.neighbours()
            b.product()
            return b.links

        for batch in batches:
            found = []
            texts = pa.array([unpack.decompress(x).decode() for x in batch["packed"].to_pylist()], pa.large_string())
            for own, sid, tile, s in zip(batch["block"].to_pylist(), batch["sid"].to_pylist(), batch["tile"].to_pylist(), shingle_sets(texts, width)):
                if own != block:
                    found += done()
                    block, held = own, ([], [], [])
                for to, x in zip(held, (sid, s, tile)):
                    to.append(x)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
        if found := done():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return work.select("block", "sid", "tile", "packed").mapInArrow(run, "a long, b long")


def jaccard_components(documents: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) for every row of ``documents`` (doc_id, text).

    Two rows link when their sets of distinct ``width``-word shingles have 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable, the row's own included. Rows without words (null or empty text) have no
    set and keep their own doc_id. Rows repeated under one doc_id are linked by their texts like any others; null
    doc_ids take part and count as largest, so component_id is null only where no member has one.
    """
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = materialize(_sets(docs, width), "sets")
    rows, grams = first.filter("gram is null").drop("gram"), first.filter("gram is not null")
    often = grams.groupBy("gram").agg(F.sum("n").alias("c")).filter(f"c > {SHORT}").orderBy(F.col("c").desc(), "gram").limit(MARKED)
    marked = np.fromiter((r[0] for r in often.select("gram").toLocalIterator()), np.int64)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a task holds its block of columns whole: about a million rows of 24 bytes
    column_parts = max(parts, total * (100 - percent) // 100 // 1_000_000 + 1)
    met = materialize(_blocked(_incidence(docs, marked, percent, width), percent, column_parts), "meetings")
    edges = materialize(_candidates(met, percent, parts), "candidates")
    drop(met)
    groups = connected_components(edges).select(F.col("node").alias("s"), F.col("root").alias("group"))
    sizes = rows.filter("n > 0").groupBy("sid").agg(F.max("n").alias("n"))
    groups = materialize(sizes.join(groups, sizes["sid"] == groups["s"]).select("sid", "group", "n"), "groups")
    drop(edges)
    texts = _involved(docs, groups.select(F.col("sid").alias("s")), groups.count(), width)
    links = materialize(_linked(groups, texts, percent, width, parts), "links")
    drop(groups)
    roots = materialize(connected_components(links), "roots")
    classes = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    joined = materialize(classes.join(roots, classes["sid"] == roots["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root")), "classes")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = joined.join(least, "root").select(F.col("sid").alias("s"), "component_id")
    found = rows.join(of_class, (rows["sid"] == of_class["s"]) & (rows["n"] > 0), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")


def one_of_each(documents: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """``documents``, all columns, with one row left of each component: the row whose doc_id is the component's.

    Of several such rows that with the smallest text hash stays, of equal rows any one. Rows without words stay, one for each doc_id; rows without
    doc_id stay unless a linked row has one.
    """
    found = materialize(jaccard_components(documents, percent, width), "components")
    own = found.filter("component_id = doc_id").groupBy("component_id", (F.col("n_shingles") > 0).alias("worded")).agg(F.min("text_hash").alias("best"))
    own = own.select(F.col("component_id").alias("c"), "worded", "best")
    same = (found["component_id"] == own["c"]) & ((found["n_shingles"] > 0) == own["worded"])
    gone = found.join(own, same, "left").filter("c is not null and not (doc_id <=> c and text_hash = best)").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct()
    again = found.filter("doc_id is not null").groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"))
    columns, keyed = documents.columns, documents.withColumns({"__d0": F.col("doc_id").cast("long"), "__t0": F.xxhash64(F.col("text").cast("string"))})
    hit = F.col("__d0").eqNullSafe(F.col("__d")) & (F.col("__t0") == F.col("__t"))
    left = keyed.join(materialize(gone, "gone"), hit, "left_anti")
    again = materialize(again, "again")
    if not again.isEmpty():
        left = left.join(again, hit, "left_anti").unionByName(left.join(again, hit, "left_semi").dropDuplicates(["__d0", "__t0"]))
    return left.select(*columns)

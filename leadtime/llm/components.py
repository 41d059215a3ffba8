"""Connected components of an edge table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

#: Edges that a task contracts at a time, some 100 bytes each while it does.
CHUNK = 1_000_000


def _forest(ends: np.ndarray) -> pa.RecordBatch:
    """(node, root) of each node that is not its part's smallest: hook every end to the smaller root and halve paths until nothing moves."""
    nodes, at = np.unique(ends, return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:
        u, v = root[at[:, 0]], root[at[:, 1]]
        apart = u != v
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """The same components with fewer edges (a > b): those that a task holds, CHUNK at a time, become stars around their smallest nodes.

    About ``n`` edges go to no more tasks than there are chunks, since a task contracts the more the more of them it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(np.stack([b["a"].to_numpy(), b["b"].to_numpy()], 1))
            size += b.num_rows
            if size >= CHUNK:
                yield _forest(np.concatenate(held))
                held, size = [], 0
        if size:
            yield _forest(np.concatenate(held))

    return edges.coalesce(n // CHUNK + 1).mapInArrow(run, "a long, b long")


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (``large``: the larger ones, else the smaller ones and itself) joined to its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = both.select(F.col("v").alias("u"), F.col("u").alias("v"))
    every = both.unionByName(back) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = every.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = every.join(least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    Tasks first contract what edges they hold; large-star and small-star steps then alternate until a round changes nothing. A round is two
    grouped minima over the edges, reduced on the map side, and no row holds a neighbour list, so a node may have any share
    of the edges. Every round is written to the shared folder, so a lost executor costs one round. Each round that changes something makes ends
    smaller, so it ends. Self-loops and repeated edges are legal; null ends are dropped; without edges there are no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null")
    e = materialize(e, "edges")
    current, seen = materialize(_contracted(e.filter("a <> b"), e.count()), "forest"), None
    while True:
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen, before = state, current
        current = materialize(_contracted(_starred(_starred(before, True), False), state[0]), "forest")
        drop(before)
    ends = [current.select(F.col("a").alias("node"), F.col("b").alias("root")), current.select(F.col("b").alias("node"), F.col("b").alias("root")), e.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))]
    return ends[0].unionByName(ends[1]).unionByName(ends[2]).groupBy("node").agg(F.min("root").alias("root"))

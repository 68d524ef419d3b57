"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.checkpoints import cut
from twinlake.session import give_back

#: Edges that a task contracts by itself, about.
EDGES = 200_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` numbered nodes reaches over edges ``(a, b)``. All edges between roots are
    taken at once: the larger root of each goes below the smallest that it is tied to, and every node then points at its root."""
    parent = np.arange(n)
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges ``(u, v)``: an edge from every node to the smallest one that it reaches.
    Nodes are numbered in their order, so the smallest number is the smallest node."""
    parts = list(batches)
    if not parts:
        return
    u, v = (pa.chunked_array([p.column(k) for p in parts]).combine_chunks() for k in "uv")
    nodes = pc.unique(pa.chunked_array([u, v]))
    nodes = nodes.take(pc.sort_indices(nodes))
    root = roots(*(pc.index_in(x, nodes).to_numpy() for x in (u, v)), len(nodes))
    below = np.flatnonzero(root != np.arange(len(root)))
    for k in range(0, len(below), 10_000):
        some = below[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(some)), nodes.take(pa.array(root[some]))], names=["u", "v"])
    del parts, u, v, nodes, root, below
    give_back()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node reachable.

    Tasks of about ``EDGES`` edges first contract theirs by union-find to a forest of stars. Where there are
    several tasks, alternating large-star and small-star rounds (Kiveris et al., 2014) join the stars: every round
    is two aggregations with map-side combine and two joins that AQE may split, so no neighbour list is ever
    gathered in one place. Null ends and self-loops add no edge (a self-loop alone adds no node).
    An empty edge table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    rows = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    kind = rows.schema["u"].dataType.simpleString()
    tasks = max(1, math.ceil(rows.count() / EDGES))
    pairs = cut(rows.repartition(tasks).mapInArrow(contracted, f"u {kind}, v {kind}"))
    before = None
    while tasks > 1:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)

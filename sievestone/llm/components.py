"""Connected components of a large graph of links, as joins and grouped minima over written tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_saved, saved


#: Links (16 bytes each) that one task may join, where the caller lets Python do that; more are joined in rounds.
ONE_TASK = 1 << 18


def components(links: DataFrame, a: str = "a", b: str = "b", python: bool = False) -> DataFrame:
    """(node, component) of every node with a link; component is the least node that links reach.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each node's larger neighbours, then its smaller
    ones, are tied to the least neighbour, until nothing changes. Rounds grow with the logarithm of the longest chain.
    Minima are combined before shuffling, so a node with very many links sends one row per task; no group is collected.
    Null ends and links of a node to itself are left out.

    python: nodes are longs, and up to ONE_TASK links are counted and joined by one task instead, which saves dozens of small stages.
    """
    edges = saved(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links"
    )
    if python and edges.count() <= ONE_TASK:
        return edges.repartition(1).mapInArrow(_joined, "node long, component long")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "links")
        now = _mark(after)
        drop_saved(edges)
        edges = after
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links, but for a chance of about 2**-60."""
    x = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(x.bitwiseAND(F.lit((1 << 32) - 1))), F.bit_xor(x)).first())


def _joined(batches):
    """(node, component) of all links (u, v)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])

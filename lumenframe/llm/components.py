"""Connected components of a set of links, by alternating large and small stars.

Each round hangs every node's larger neighbours on its least one (large star), then
its smaller neighbours on the least of them (small star), until nothing changes; then
each component is a star around its least node. Only per-node minima are aggregated,
combined before the shuffle, and joined back, so that a node of very many links never
has to be gathered. Each round is checkpointed, to cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node that has a link to another; component: its least node."""
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = durable(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

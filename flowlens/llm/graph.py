"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node with a link to another; component is the least node reachable.

    Alternates two star steps on links (hi, lo): each node hands its larger neighbours to its least neighbour, then
    its smaller ones. Both keep the components, and their number of rounds grows with the logarithm of the longest
    path. Nodes with many links are summed by partial minimums and joined, never gathered; minimums are dealt out
    anew before a join, so that both sides come from shuffles of its own and a node's links can be split among tasks.
    Each round is written to the shared folder.
    """
    spread = F.xxhash64("hi", "m")
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    edges = settle(links.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "links")
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m")).repartition(spread)
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least.repartition(spread), "hi")
        small = joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        edges = settle(small, f"stars{step}")
        step += 1
        twice = edges.groupBy("hi").count().where("count > 1").select("hi")
        deep = edges.select(F.col("lo").alias("hi")).distinct().join(edges.select("hi"), "hi", "left_semi")
        if twice.unionByName(deep).isEmpty():
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())

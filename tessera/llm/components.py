"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (id, component) of every linked id; component is the least id it reaches.

    Alternating large-star and small-star rounds: every node hangs its larger,
    then its smaller neighbours under the least of them.  The number of rounds
    grows with the logarithm of the longest chain.  A hub costs an aggregation
    with map-side combine and a join that may be split, never one task with all
    its links in memory.
    """
    edges = cut_lineage(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut_lineage(hung.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

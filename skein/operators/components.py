"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import kept


def connected(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for each node of ``links`` (a, b: long), by alternating stars.

    Rounds are sums by node and plain joins, so that a node of very many links is summed up before it is shuffled and
    can be split where it is joined. Rounds grow with the logarithm of the number of nodes. Nulls and links of a node
    with itself tie nothing.
    """
    edges = kept(links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = kept(both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        small = large.join(least(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = kept(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v")).distinct()

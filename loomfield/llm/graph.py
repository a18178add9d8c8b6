"""Connected components of links by large-star and small-star steps; links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of links (a, b): the smallest node that can be reached. Rounds go on until the
    edges stay as they are, which takes about the logarithm of the longest chain, squared at most."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        old, edges = edges, materialize(small, "edges")
        forget(old)
        after = state(edges)
        if before == after:
            break
        before = after
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())

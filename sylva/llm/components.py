"""Connected components of links, by alternating large-star and small-star steps over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.runtime import materialise, release


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node that it reaches.

    Each step is a combinable minimum and a join; the neighbours of a node are never gathered. Steps go on until
    neither changes the set of links, about log of the longest path times; each is written to the shared folder.
    Null ends and links of a node to itself are left out. An empty table gives an empty result.
    """
    held = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        total = held.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(total) == before or not total[0]:
            break
        before = tuple(total)
        for large in (True, False):
            nearest = neighbours(held, large)
            nxt = materialise(nearest, "star")
            release(held)
            held = nxt
    found = held.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def neighbours(links: DataFrame, large: bool) -> DataFrame:
    """One star step: links of each node are moved to its smallest neighbour (or itself)."""
    if large:  # every neighbour that is larger is linked to the smallest neighbour
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        moved = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:  # every neighbour that is smaller, and the node, are linked to the smallest neighbour
        low = links.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        moved = links.join(low, links["u"] == low["x"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

"""Exact copies of whole texts, found by a digest before anything that costs more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.runtime import materialise

#: Groups of copies in one broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def mark_copies(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """rows with _first: the smallest key among the rows of an equal text, null where the text stands once.

    The groups are counted before the shuffle, so a text of many rows is no hot key; only groups of two and more are
    joined back, by broadcast if they are few.
    """
    digest = F.unhex(F.sha2(text, 256))
    groups = rows.select(F.col(key).alias("_key"), digest.alias("_sha")).filter(F.col("_key").isNotNull()).groupBy("_sha").agg(F.min("_key").alias("_first"), F.count("*").alias("_n"))
    groups = materialise(groups.filter("_n > 1").select("_sha", "_first"), "copies")
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.withColumn("_own", digest).join(F.broadcast(groups) if few else groups, F.col("_own") == F.col("_sha"), "left").drop("_own", "_sha")

"""Incremental work by Structured Streaming: checkpoints take the part of recovery files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def process_new_files(spark: SparkSession, source: str, schema: StructType | str, form: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Run work over the files below source that no earlier run with this checkpoint has finished, and append to target.

    Each run takes what is there (availableNow) and ends. A lost executor repeats tasks; a failed run repeats its
    last batch, whose files the file sink counts once.
    """
    stream = spark.readStream.format(form).schema(schema).option("recursiveFileLookup", True).load(source)
    query = work(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()


def tumbling(events: DataFrame, length: str, late: str, time: str = "ts") -> DataFrame:
    """(start, end, event_type, n, total) of closed windows; rows later than `late` behind the latest time are left out."""
    timed = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", length), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", F.col("total").cast("double").alias("total"))

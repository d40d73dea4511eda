"""Resumable work: manifests of what is done under which parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def outstanding(work: DataFrame, manifest: DataFrame, key: str, parameters: str) -> DataFrame:
    """Work that the manifest doesn't list under the same parameters."""
    done = manifest.filter(F.col("parameters") == parameters).select(key).distinct()
    return work.join(done, key, "left_anti").select(*work.columns)


def incomplete(tiles: DataFrame, outputs: DataFrame, group: str, key: str) -> DataFrame:
    """Groups (images) whose outputs are fewer than their tiles: group, expected, made."""
    made = outputs.join(tiles.select(group, key).distinct(), [group, key], "left_semi").groupBy(group).agg(F.countDistinct(key).alias("made"))
    counted = tiles.groupBy(group).agg(F.countDistinct(key).alias("expected")).join(made, group, "left").fillna(0, ["made"])
    return counted.filter("made < expected")


def read_manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The manifest at path, or an empty one if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"`{key}` string, parameters string, ok boolean")


def record(done: DataFrame, path: str, key: str, parameters: str) -> None:
    """Append finished keys. done: (key, ok); failed ones are recorded as such and stay outstanding."""
    done.select(F.col(key).cast("string").alias(key), F.lit(parameters).alias("parameters"), "ok").write.mode("append").parquet(path)


def resume(work: DataFrame, path: str, key: str, parameters: str) -> DataFrame:
    """Work that wasn't finished well under these parameters before."""
    finished = read_manifest(work.sparkSession, path, key).filter("ok")
    return outstanding(work, finished, key, parameters)


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows) of a result whose error column is null for good rows: one bad item doesn't end a job."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def progress(work: DataFrame, done: DataFrame, group: str) -> DataFrame:
    """(group, total, finished, percent)."""
    total = work.groupBy(group).agg(F.count("*").alias("total"))
    made = done.groupBy(group).agg(F.count("*").alias("finished"))
    joined = total.join(made, group, "left").fillna(0, ["finished"])
    return joined.withColumn("percent", F.round(100 * F.col("finished") / F.col("total"), 2))

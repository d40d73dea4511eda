"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import sql
from sylva.llm.chat import format_chats, read_chats
from sylva.llm.decontamination import leaks
from sylva.llm.jaccard_join import jaccard_components
from sylva.llm.language_model import fold, score_texts
from sylva.llm.quality import quality
from sylva.llm.repeats import remove_repeats
from sylva.llm.sentencepiece_codec import round_trip
from sylva.llm.session import prepare
from sylva.llm.token_counts import token_counts
from sylva.llm.toxicity import toxicity
from sylva.llm.warc import read_warc, write_warc
from sylva.runtime import materialise, scratch

TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, materialise)
    found = read_warc(spark.read.format("binaryFile").load(path))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start_word"), F.round("similarity", 6).alias("similarity"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), settle=materialise)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) == 0)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return read_chats(format_chats(turns.unionByName(own)))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": op1_language_model,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

ORACLES: dict[str, str] = {
    "op3_warc": sql.WARC,
    "op6_jaccard_join": sql.JACCARD,
    "op7_quality_rules": sql.QUALITY,
    "op9_chat_formatting": sql.CHAT,
    "op10_suffix_array_dedup": sql.REPEATS,
}

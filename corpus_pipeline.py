"""The corpus pipeline: stages of the training-data operators, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return
the columns of documents, and extra columns of docs, whatever their names, are left out. Rows that share an id count as
one document for the stages that drop documents. Null texts fail the quality rules; texts of any length go through
whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import queries as llm
from sylva.llm.decontamination import without_leaks
from sylva.llm.jaccard_join import BROADCAST_IDS, jaccard_components
from sylva.llm.quality import kept_documents
from sylva.llm.repeats import remove_repeats
from sylva.llm.sentencepiece_codec import encode_texts
from sylva.llm.session import prepare
from sylva.runtime import materialise, relieve

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share four fifths of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def begin(spark: SparkSession) -> None:
    prepare(spark)
    relieve(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    begin(spark)
    return kept_documents(docs.select(*COLUMNS), materialise)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that n-gram Jaccard links connect."""
    begin(spark)
    docs = docs.select(*COLUMNS)
    groups = jaccard_components(docs, SHINGLE, PERCENT)
    gone = materialise(groups.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a document with a smaller id has too; texts that were all repeats go."""
    begin(spark)
    left = remove_repeats(docs.select(*COLUMNS), kept_text=True)
    left = left.filter((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0))
    changed = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", changed.alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    begin(spark)
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether the backend agreed with the library on them."""
    begin(spark)
    return encode_texts(docs.select(*COLUMNS)).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", tokens),
]
#: SQL can't express the fourth stage's fingerprints and the fifth stage's merges; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = llm.table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

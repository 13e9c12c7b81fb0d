"""A training corpus in five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.decontam import decontaminate
from loomdex.llm.langid import UNKNOWN, identify, train
from loomdex.llm.mixing import mix_sources
from loomdex.llm.simhash import near_dedup
from loomdex.llm.substring import dedup_substrings
from loomdex.shared import cut

#: A document is rejected if it is in none of the trained languages with at least this posterior.
REJECT_CONFIDENCE = 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those surely in no trained language; the source stands for the host. Textless documents stay."""
    judged = identify(docs, train(docs), host=F.col("source"), keep_text=True)
    rejected = (F.col("language") == UNKNOWN) & (F.col("confidence") >= REJECT_CONFIDENCE)
    return judged.where(~rejected).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return near_dedup(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller id holds; those without any are unchanged."""
    found = dedup_substrings(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those contaminated by benchmark items; the others are unchanged."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when."""
    return mix_sources(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]

#: Similarity groups, factors and the language model are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

"""Names of the engine's queries, their callables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomdex.plans import corpus_queries, event_queries, retrieval_queries, study_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (text_queries, retrieval_queries, corpus_queries, study_queries, event_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 answers to all benchmark questions."""
    return retrieval_queries.bm25_topk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: function for module in MODULES for name, function in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

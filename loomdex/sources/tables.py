"""The Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; filters and column choices of later steps reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def version(spark: SparkSession, folder: str, name: str) -> tuple:
    """What changes when a file of a table is added, removed or rewritten: from names, sizes and times, without contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{name}.parquet")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())

"""A keyed table in hash buckets: an upsert rewrites the buckets of its keys and leaves the files of all others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from loomdex.shared import cut, exists

BUCKETS = 64
_OWN = ("__bucket", "__gone")


@dataclass
class KeyedTable:
    """Rows of a key in a folder, one folder a bucket; a key has the rows of its highest version.

    Rows of a version below the stored one are passed over, those of an equal one replace
    it. Deleted keys leave a marker with the version of their deletion. A write that is
    repeated after a failure gives the same table. One writer at a time.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    version: str
    buckets: int = BUCKETS

    def _whole_schema(self) -> StructType:
        return StructType([*self.schema.fields]).add("__gone", BooleanType()).add("__bucket", IntegerType())

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self._whole_schema()).parquet(self.path)

    def _exists(self) -> bool:
        return exists(self.spark, self.path)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """The rows of all keys; empty before the first write."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        return self._stored().where(~F.col("__gone")).drop(*_OWN)

    def upsert(self, rows: DataFrame, checks: dict[str, int] | None = None) -> list[int]:
        """Replaces all rows of each key of `rows` unless a higher version is stored; gives the buckets written.

        Of several versions in `rows` the highest counts. `checks` names vector columns and
        their length; another length, or null, fails the write before anything is stored.
        """
        rows = rows.select(*self.schema.names)
        for column, size in (checks or {}).items():
            wrong = F.concat(F.lit(f"{column} has length "), F.coalesce(F.size(column), F.lit(-1)), F.lit(f", not {size}"))
            rows = rows.withColumn(column, F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(wrong)))
        return self._merge(rows.withColumn("__gone", F.lit(False)))

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes keys (key, version) that are stored with this version or a lower one; gives the buckets written."""
        return self._merge(self.spark.createDataFrame([], self.schema).unionByName(keys.select(self.key, self.version), allowMissingColumns=True).withColumn("__gone", F.lit(True)))

    def _merge(self, rows: DataFrame) -> list[int]:
        # rows are read three times from here on
        rows = cut(rows.withColumn("__bucket", self.bucket_of(F.col(self.key))))
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
        if not touched:
            return touched
        both = rows.withColumn("__new", F.lit(True))
        if self._exists():
            both = both.unionByName(self._stored().where(F.col("__bucket").isin(touched)).withColumn("__new", F.lit(False)))
        newest = both.groupBy(F.col(self.key).alias("__key")).agg(F.max(F.struct(self.version, "__new")).alias("__newest"))
        chosen = F.col(self.key).eqNullSafe(F.col("__key")) & F.struct(F.col(self.version).alias(self.version), F.col("__new").alias("__new")).eqNullSafe(F.col("__newest"))
        # the buckets that are read here are written below
        merged = cut(both.join(newest, chosen, "left_semi").drop("__new"))
        merged.hint("rebalance", "__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(self.path)
        return touched

"""Tables that are kept and brought up to date by key: scored predictions by model, stress results by model and test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class StoredTable:
    """A Parquet folder partitioned by ``by``.

    ``put`` replaces exactly the partitions it has rows for, so a rerun of one model or test rewrites only its own files, and
    readers of one model open only its own. The folder must be one that driver and executors share.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str]):
        self.spark, self.path, self.schema, self.by = spark, path, schema, list(by)

    def put(self, rows: DataFrame) -> "StoredTable":
        """Upsert by partition. A null key is a partition of its own."""
        writer = rows.select(self.schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*self.by).parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)

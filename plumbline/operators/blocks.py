"""Cut an ordered table into numbered ranges.

Rows are range-partitioned along all ordering columns together, of any orderable types, so a value of the leading column
that very many rows share is cut along the next one. Null keys come first, as in Spark's ascending order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

BLOCK = "__block"


def range_blocks(df: DataFrame, order_by: list[str], blocks: int | None = None) -> DataFrame:
    """Add ``__block``: equal or growing along ``order_by``. ``blocks`` defaults to the number of shuffle partitions.

    The ranges are written out, so that every later read sees the same ones.
    """
    if blocks is None:
        blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(blocks, *order_by).withColumn(BLOCK, F.spark_partition_id().cast("bigint")))

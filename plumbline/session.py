"""Session helpers: a local session for tests and the lineage cut used by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema




def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder named by ``spark.checkpoint.dir``, set on the context once.

    Only a local session without that setting, as in tests, gets a scratch folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and return it with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def held(df: DataFrame) -> DataFrame:
    """``df``, kept after its first use: for small results that several others are made from.

    Parts lost with an executor are computed again; no folder is needed.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._plumbline_shipped = True


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Driver rows as a local relation.

    Its size is known to the optimizer, which broadcasts it only while it is small; rows passed as
    a plain list would have no size and force a shuffle of whatever they are joined to.
    """
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    table = pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)

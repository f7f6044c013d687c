"""The folder of saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def artifact_path(root: str, name: str) -> str:
    """Default folder of a model: lower case, spaces as underscores."""
    return f"{root}/{name.lower().replace(' ', '_')}"


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """(folder, display_name) of every saved model, from the metadata file each one holds."""
    files = spark.read.text(f"{root}/*/metadata/part-*").select(F.input_file_name().alias("file"))
    folder = F.regexp_extract("file", r"([^/]+)/metadata/[^/]+$", 1)
    return (
        files.select(folder.alias("folder"))
        .distinct()
        .select("folder", F.initcap(F.regexp_replace("folder", "_", " ")).alias("display_name"))
        .orderBy("folder")
    )

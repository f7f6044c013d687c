"""Input tables. A missing value is NULL everywhere, so NaN is turned into NULL on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import records


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


# Words that stand for a missing value in a CSV cell.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)

_CASTS = ("bigint", "double", "boolean")


# Cells are parsed one record at a time; line breaks inside quotes stay as they are.
_CELLS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Headed CSV with doubled quotes inside quoted cells, and missing-value words as NULL.

    Cells may hold line breaks; files are read in splits all the same (``records``). Every cell is read as text first. Without
    a schema a column becomes bigint, double or boolean if all its values are such, else text; that costs one extra pass.
    """
    names = spark.read.options(header=True, inferSchema=False, **_CELLS).csv(path).columns  # reads the first header only
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    kinds = ", ".join(f"c{i} STRING" for i in range(len(names)))
    parsed = records(spark, path).select(F.from_csv(F.regexp_replace("record", r"\r\z", ""), kinds, _CELLS).alias("r"))
    cells = parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    missing = [F.when(~F.col(f"`{c}`").isin(*MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in cells.columns]
    rows = cells.select(*missing)
    if schema is not None:
        kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        names = {f.name: f.dataType for f in kinds.fields}
        return nan_to_null(rows.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in names.items()]))
    fits = [
        F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | _reads(F.col(f"`{c}`"), k)), F.lit(False)).alias(f"{i}_{k}")
        for i, c in enumerate(rows.columns)
        for k in _CASTS
    ]
    filled = [F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(rows.columns)]
    found = rows.agg(*fits, *filled).first()
    typed = []
    for i, c in enumerate(rows.columns):
        kind = next((k for k in _CASTS if found[f"{i}_{k}"]), "string") if found[f"{i}_n"] else "double"
        typed.append(F.col(f"`{c}`").cast(kind).alias(c))
    return nan_to_null(rows.select(*typed))


def _reads(cell, kind: str):
    if kind == "boolean":
        return cell.isin("True", "False", "TRUE", "FALSE", "true", "false")
    return cell.try_cast(kind).isNotNull() & (~cell.rlike("(?i)[dfl]$") | cell.rlike("(?i)inf$"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))

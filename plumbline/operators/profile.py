"""Table profiling. Counts of all columns come from one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import small_frame
from .order_stats import column_quantiles

MEGABYTE = 1024.0**2
LONG_TEXT = 64

# Bytes per value of the fixed-width types.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}
WIDE = 8


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; a boolean is neither numeric nor categorical."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _unpivot_row(row: DataFrame, names: Sequence[str], measures: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Turn a one-row frame with ``<measure>_<i>`` columns into one row per column name."""
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
            for i, n in enumerate(names)
        ]
    )
    return row.select(*extra, F.inline(entries))


def shape(df: DataFrame) -> DataFrame:
    """Row and column count, and the number of columns of each kind."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).alias("categorical_columns"),
    )


def missing(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct) for every column."""
    names = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(_col(c)).alias(f"filled_{i}") for i, c in enumerate(names)]
    )
    lost = F.col("rows") - F.col("filled")
    pct = F.when(F.col("rows") > 0, lost / F.col("rows") * F.lit(100.0))
    return _unpivot_row(row, names, ["filled"], ["rows"]).select(
        "column", lost.alias("missing"), pct.alias("missing_pct")
    )


def missing_only(df: DataFrame) -> DataFrame:
    """Columns with missing values and their formatted percentage."""
    return (
        missing(df)
        .filter(F.col("missing") > 0)
        .select("column", "missing", text.fixed(F.col("missing_pct"), 2, "%").alias("missing_pct"))
    )


def columns_with_missing(df: DataFrame) -> DataFrame:
    return missing(df).filter(F.col("missing") > 0).select("column")


def row_identity(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Grouping columns that tell rows apart: a long string is stood for by its SHA-256 digest.

    Shuffling digests keeps whole documents out of the exchange; short values go as they are.
    """
    kept = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c = _col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(F.octet_length(c) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(
                F.concat(F.lit("="), c)
            )
        kept.append(c.alias(f"__id_{len(kept)}"))
    return kept


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row over ``columns`` (nulls equal)."""
    groups = df.groupBy(*row_identity(df, columns)).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - F.lit(1)), F.lit(0)).alias("duplicates"))


def size_mb(df: DataFrame) -> DataFrame:
    """Estimated size: string bytes plus fixed widths, in MiB."""
    total = None
    for f in df.schema.fields:
        c = _col(f.name)
        if isinstance(f.dataType, T.StringType):
            part = F.coalesce(F.sum(F.octet_length(c).cast("bigint")), F.lit(0))
        else:
            part = F.count(F.lit(1)) * F.lit(WIDTHS.get(f.dataType.simpleString(), WIDE))
        total = part if total is None else total + part
    return df.agg((total / F.lit(MEGABYTE)).alias("size_mb"))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First rows in an explicit order; a distributed table has no file order."""
    return df.orderBy(*order_by).limit(n)


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, distinct) of non-null values.

    One long (column, value) frame and one distinct aggregate: duplicates collapse map-side and
    the distinct pairs are spread over the cluster, instead of one expansion per column.
    """
    if approximate:
        names = df.columns
        row = df.agg(*[F.approx_count_distinct(_col(c)).alias(f"distinct_{i}") for i, c in enumerate(names)])
        return _unpivot_row(row, names, ["distinct"])
    keys = row_identity(df)
    pairs = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                (
                    k + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else k
                ).cast("string").alias("value"),
            )
            for f, k in zip(df.schema.fields, keys)
        ]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("column")
        .agg(F.count_distinct("value").alias("distinct"))
    )


def column_info(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, filled and missing count, missing percentage (2 digits) and distinct count per column."""
    kinds = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"))
            for f in df.schema.fields
        ]
    )
    names = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(_col(c)).alias(f"non_null_{i}") for i, c in enumerate(names)]
    ).select("*", kinds.alias("kinds"))
    lost = F.col("rows") - F.col("non_null")
    counted = _unpivot_row(row, names, ["non_null"], ["rows", "kinds"]).select(
        "column",
        F.filter("kinds", lambda k: k["column"] == F.col("column"))[0]["dtype"].alias("dtype"),
        "non_null",
        lost.alias("null_count"),
        F.when(F.col("rows") > 0, F.round(lost / F.col("rows") * F.lit(100.0), 2)).alias("null_pct"),
    )
    return counted.join(distinct_counts(df, approximate), "column", "left").fillna(0, ["distinct"])


def totals(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows from a single grouping of the table."""
    groups = df.groupBy(*row_identity(df)).agg(F.count(F.lit(1)).alias("copies"))
    ids = [c for c in groups.columns if c != "copies"]
    blanks = sum((F.col(c).isNull().cast("int") for c in ids), F.lit(0))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") * blanks), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.col("copies") - F.lit(1)), F.lit(0)).alias("duplicates"),
    ).select("rows", F.lit(len(df.columns)).alias("columns"), "missing", "duplicates")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum of numeric columns."""
    names = list(columns) if columns is not None else numeric_columns(df)
    moments = [
        measure(_col(c).cast("double")).alias(f"{name}_{i}") for i, c in enumerate(names) for name, measure in _MOMENTS.items()
    ]
    row, quartiles = column_quantiles(df, names, (0.25, 0.5, 0.75), moments)
    measured = {name: [row[f"{name}_{i}"] for i in range(len(names))] for name in _MOMENTS}
    rows = [
        (c, *[measured[m][i] for m in ("count", "mean", "std", "min")], *quartiles[c], measured["max"][i]) for i, c in enumerate(names)
    ]
    numbers = ("mean", "std", "min", "p25", "p50", "p75", "max")
    fields = [T.StructField("column", T.StringType()), T.StructField("count", T.LongType())]
    return small_frame(df.sparkSession, rows, T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in numbers]]))


_MOMENTS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def validate(df: DataFrame) -> dict[str, DataFrame | list]:
    """The validation report as its parts."""
    return {
        "shape": shape(df),
        "columns": df.columns,
        "dtypes": [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "missing": missing(df),
        "duplicates": duplicates(df),
        "numeric_columns": numeric_columns(df),
        "categorical_columns": categorical_columns(df),
        "size_mb": size_mb(df),
    }

"""Registry and the SQL text helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import keyed


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query and, where SQL can express it, the statement that checks it."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query: {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result frame for comparison: doubles rounded, integers widened to bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def num(x: float) -> str:
    """A double literal; plain decimals would be DECIMAL in SQL."""
    return f"{float(x)!r}::DOUBLE"


def rounded(expr: str, digits: int) -> str:
    """Rounded double; adding zero removes a negative zero."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0e0)"


def r6(expr: str) -> str:
    return rounded(expr, 6)


def big(expr: str) -> str:
    return f"({expr})::BIGINT"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fixed(expr: str, digits: int, suffix: str = "") -> str:
    return f"printf('%.{digits}f{suffix.replace('%', '%%')}', round(({expr})::DOUBLE, {digits}))"


def percent(expr: str, digits: int) -> str:
    return fixed(f"({expr}) * 100e0", digits, "%")


def digest(seed: int, tag: str, part: str, key: str) -> str:
    """``tag``, ``part`` and ``key`` are SQL expressions."""
    return f"md5(concat_ws('|', '{seed}', {tag}, {part}, ({key})::VARCHAR))"


def uniform(dig: str, slot: int) -> str:
    return f"((('0x' || substr({dig}, {8 * slot + 1}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def ordering(dig: str) -> str:
    return f"((('0x' || substr({dig}, 1, 13))::BIGINT)::DOUBLE / {float(2**52)!r}::DOUBLE)"


def bin_sql(x: str, edge_list: list[float]) -> str:
    """Number of interior edges <= x."""
    return "(" + " + ".join(f"(CASE WHEN {x} >= {num(e)} THEN 1 ELSE 0 END)" for e in edge_list[1:-1]) + ")"


def words_sql(seed: int, key: str) -> str:
    """w0..w3 of a row."""
    dig = f"md5(concat_ws('|', '{seed}', ({key})::VARCHAR))"
    return ", ".join(f"('0x' || substr({dig}, {7 * i + 1}, 7))::BIGINT AS w{i}" for i in range(keyed.WORDS))


def mix_sql(terms: list[str], coefs) -> str:
    return "((" + " + ".join(f"{t} * {c}::BIGINT" for t, c in zip(terms, coefs)) + f") % {keyed.PRIME}::BIGINT)"


def line_sql(terms: list[str], *label) -> str:
    return mix_sql(terms, keyed.coefficients(*label))


def bent_sql(drawn: str) -> str:
    """Fifth power modulo 2^31 - 1."""
    p = "2147483647::BIGINT"
    return f"((((({drawn} * {drawn}) % {p}) * (({drawn} * {drawn}) % {p})) % {p} * {drawn}) % {p})"


def open_uniform_sql(drawn: str) -> str:
    return f"(({drawn}::DOUBLE + 0.5::DOUBLE) / {num(keyed.PRIME)})"


def fine_uniform_sql(high: str, low: str) -> str:
    return f"(({high}::DOUBLE * {num(2**21)} + ({low} % {2**21}::BIGINT)::DOUBLE) / {num(2**52)})"

"""Encoding, splitting and scaling. Fitted values are small and become literals in a projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import keyed
from ..session import settle
from .selection import cuts

# The category of a missing label, the class count below which a split is stratified.
MISSING_CATEGORY = "nan"
STRATIFY_BELOW = 10

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def codebook(df: DataFrame, column: str) -> DataFrame:
    """(category, code): codes are ranks of the sorted distinct values from 0, null counts as 'nan'.

    No task sorts all categories: they are range-partitioned and written out, so that both reads see
    the same partitions, and each partition's ranks start after those of the partitions before.
    """
    categories = df.select(F.coalesce(F.col(column), F.lit(MISSING_CATEGORY)).alias("category")).distinct()
    placed = settle(
        categories.repartitionByRange("category")
        .sortWithinPartitions("category")
        .select("category", F.monotonically_increasing_id().alias("__place"))
    )
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__offset"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row per partition of the categories
        .select("category", (F.col("__offset") + inside).cast("int").alias("code"))
    )


def label_encode(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(encoded frame, mapping(column, category, code)). Only string columns are encoded.

    The codebook join is left to the optimizer: broadcast while the codebook is small, shuffled
    with skew handling when it is not. Nulls don't take part in the join: their code is a literal.
    """
    mapping = df.sparkSession.createDataFrame([], "column string, category string, code int")
    order = df.columns
    for column in columns:
        if column not in order or not isinstance(df.schema[column].dataType, T.StringType):
            continue
        book = codebook(df, column)
        mapping = mapping.unionByName(book.select(F.lit(column).alias("column"), "category", "code"))
        missing = book.filter(F.col("category") == MISSING_CATEGORY).select("code").first()
        coded = book.select(F.col("category").alias("__category"), F.col("code").alias("__code"))
        code = F.coalesce(F.col("__code"), F.lit(missing["code"] if missing else None).cast("int"))
        joined = df.join(coded, F.col(f"`{column}`") == F.col("__category"), "left")
        df = joined.select(*[code.alias(c) if c == column else F.col(f"`{c}`") for c in order])
    return df, mapping


def label_decode(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Category of each code, under the same column name."""
    book = mapping.filter(F.col("column") == column).select(
        F.col("code").alias(column), F.col("category").alias("__category")
    )
    joined = df.join(book, column, "left")
    return joined.select(*[F.col("__category").alias(c) if c == column else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, columns: Sequence[str], categories: dict[str, Sequence] | None = None) -> DataFrame:
    """Boolean ``{column}_{value}`` per sorted category but the first; the source column goes.

    The result has a column per category, so its categories are the driver's to know: those given,
    or else those found. For a column with very many, ``one_hot_index`` has one column for all.
    """
    kept = [c for c in df.columns if c not in columns]
    flags = []
    for column in columns:
        known = (categories or {}).get(column)
        if known is None:
            known = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect()]
        for value in sorted(known)[1:]:
            flag = F.coalesce(F.col(column) == F.lit(value), F.lit(False))
            flags.append(flag.alias(f"{column}_{value}"))
    return df.select(*kept, *flags)


def one_hot_index(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(frame, mapping(column, category, code)): the sparse form of ``one_hot`` for any number of categories.

    Each column becomes the place of its one true flag, counted from 0 over the sorted categories but the
    first; null where all flags are false, that is for the first category and for null. The places come
    from the distributed codebook, so no list of categories reaches the driver.
    """
    mapping = df.sparkSession.createDataFrame([], "column string, category string, code int")
    for column in columns:
        book = codebook(df.filter(F.col(column).isNotNull()), column)
        flags = book.filter("code > 0").select("category", (F.col("code") - 1).alias("code"))
        mapping = mapping.unionByName(flags.select(F.lit(column).alias("column"), "category", "code"))
        flags = flags.select(F.col("category").alias("__category"), F.col("code").alias("__code"))
        joined = df.join(flags, F.col(f"`{column}`") == F.col("__category"), "left")
        df = joined.select(*[F.col("__code").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
    return df, mapping


def select_features(df: DataFrame, target: str) -> list[str]:
    return [c for c in df.columns if c != target]


def largest_remainder(counts: dict, draws: int) -> dict:
    """Share ``draws`` over classes in proportion to their counts; the lowest class wins a tie."""
    total = sum(counts.values())
    exact = {c: draws * n / total for c, n in counts.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    order = sorted(counts, key=lambda c: (-(exact[c] - out[c]), c))
    for c in order[: draws - sum(out.values())]:
        out[c] += 1
    return out


def _class_counts(df: DataFrame, target: str) -> tuple[int, dict]:
    """(row count, counts per class); no class counts when the target has ten values or more.

    A sketch rules out a continuous target first, so its values are never grouped.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(target).alias("classes")).first()
    if row["classes"] >= 2 * STRATIFY_BELOW:
        return row["n"], {}
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()
    known = {r[target]: r["n"] for r in rows if r[target] is not None}
    if len(known) >= STRATIFY_BELOW:
        return row["n"], {}
    if len(known) != len(rows):
        raise ValueError("a stratified target must not be null")
    return row["n"], known


def _checked(counts: dict, take: int, keep: int) -> None:
    if counts and min(counts.values()) < 2:
        raise ValueError("every class of a stratified split needs two rows")
    if counts and min(take, keep) < len(counts):
        raise ValueError("each side of a stratified split needs a row per class")


def split(
    df: DataFrame,
    target: str,
    key: str,
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: exact test, then validation, then train sizes, stratified for few classes.

    Rows are ranked by a keyed draw; a split is a pair of literal cut-offs per class, so no row
    is shuffled. The validation share is rescaled to the rows left by the test cut.
    """
    if not (0 < test_size < 1 and 0 < val_size < 1 and test_size + val_size < 1):
        raise ValueError("test and validation shares must be positive and leave rows to train on")
    drawn = df.withColumn("__draw", keyed.ordering(keyed.digest(seed, "split", target, F.col(key))))
    n, counts = _class_counts(df, target)
    n_test = math.ceil(n * test_size)
    n_val = math.ceil((n - n_test) * (val_size / (1 - test_size)))
    if n - n_test - n_val < 1:
        raise ValueError("the shares leave no training rows")
    if counts:
        _checked(counts, n_test, n - n_test)
        left = largest_remainder(counts, n - n_test)
        tests = {c: counts[c] - left[c] for c in counts}
        _checked(left, n_val, n - n_test - n_val)
        trains = largest_remainder(left, n - n_test - n_val)
        vals = {c: left[c] - trains[c] for c in counts}
        takes = {(c,): [tests[c], tests[c] + vals[c]] for c in counts}
        found = cuts(drawn, [target], "__draw", key, takes, {(c,): m for c, m in counts.items()})
        test = _any_class(target, {c: found[((c,), tests[c])] for c in counts}, key)
        val = _any_class(target, {c: found[((c,), tests[c] + vals[c])] for c in counts}, key)
    else:
        first = cuts(drawn, [], "__draw", key, {(): [n_test]}, {(): n})[((), n_test)]
        test = first.contains(F.col("__draw"), F.col(key))
        rest = drawn.filter(~test)
        _, left = _class_counts(rest, target)
        if left:
            # the first cut left fewer than ten classes, so the second one is stratified
            _checked(left, n_val, n - n_test - n_val)
            trains = largest_remainder(left, n - n_test - n_val)
            vals = {c: left[c] - trains[c] for c in left}
            takes = {(c,): [vals[c]] for c in left}
            # ranks run from the test cut on, so the draws are rescaled to the remaining range
            span = 1.0 - first.value
            rescaled = rest.withColumn("__draw", (F.col("__draw") - F.lit(first.value)) / F.lit(span))
            found = cuts(rescaled, [target], "__draw", key, takes, {(c,): m for c, m in left.items()})
            drawn = drawn.withColumn("__rest", (F.col("__draw") - F.lit(first.value)) / F.lit(span))
            val = _any_class(target, {c: found[((c,), vals[c])] for c in left}, key, "__rest")
        else:
            second = cuts(drawn, [], "__draw", key, {(): [n_test + n_val]}, {(): n})[((), n_test + n_val)]
            val = second.contains(F.col("__draw"), F.col(key))
    label = F.when(test, F.lit(TEST)).when(val, F.lit(VALIDATION)).otherwise(F.lit(TRAIN))
    return drawn.select(*df.columns, label.alias("split"))


def _any_class(target: str, cut_of: dict, key: str, draw: str = "__draw"):
    chain = F
    for value, cut in cut_of.items():
        chain = chain.when(F.col(target) == F.lit(value), cut.contains(F.col(draw), F.col(key)))
    return F.coalesce(chain.otherwise(F.lit(False)), F.lit(False))


def split_summary(df: DataFrame, target: str) -> DataFrame | None:
    """Rows, share of all rows and class counts per split; None before splitting."""
    if "split" not in df.columns:
        return None
    counts = df.groupBy("split", F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("class_count"))
    # one row per split, so that many distinct classes of one split are not gathered for its sum
    sums = df.groupBy("split").agg(F.count(F.lit(1)).alias("samples"))
    total = F.sum("samples").over(Window.partitionBy())
    sums = sums.select("split", "samples", (F.col("samples") / total * F.lit(100.0)).alias("percentage"))
    return counts.join(F.broadcast(sums), "split").select("split", "class", "class_count", "samples", "percentage")


def scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the training rows; a constant column divides by 1."""
    row = (
        df.filter(F.col("split") == TRAIN)
        .agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        )
        .first()
    )
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, columns: Sequence[str], fitted: dict | None = None) -> DataFrame:
    """(x - mean) / deviation for every split, fitted on the training split; nulls stay null."""
    fitted = fitted or scaler(df, columns)
    return df.select(
        *[
            ((F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1])).alias(c) if c in fitted else F.col(c)
            for c in df.columns
        ]
    )

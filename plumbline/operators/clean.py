"""Cleaning: duplicate rows and missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import BLOCK, range_blocks
from .order_stats import column_quantiles

# Strategy names and which column kinds offer them.
STATISTICS = ("mean", "median", "mode")
DIRECTIONS = ("forward_fill", "backward_fill")
NUMERIC_MENU = ("mean", "median", "drop", "forward_fill", "backward_fill")
OTHER_MENU = ("mode", "drop", "forward_fill", "backward_fill")


def menu(df: DataFrame, column: str) -> tuple[str, ...]:
    """Strategies offered for a column by its type."""
    return NUMERIC_MENU if isinstance(df.schema[column].dataType, T.NumericType) else OTHER_MENU


def check_strategies(df: DataFrame, strategies: Mapping[str, str]) -> None:
    """Reject a named strategy that the column's type does not offer."""
    for column, method in strategies.items():
        if column in df.columns and method not in menu(df, column):
            raise ValueError(f"{method} is not offered for {column}")


def drop_duplicates(df: DataFrame, key: str | None = None) -> DataFrame:
    """One row per distinct combination; with a key column, the copy with the lowest key stays."""
    if key is None:
        return df.dropDuplicates()
    values = [c for c in df.columns if c != key]
    return df.groupBy(*values).agg(F.min(key).alias(key)).select(*df.columns)


def most_frequent(df: DataFrame, column: str):
    """Most frequent value, the smallest one on ties. Counts are spread over the cluster."""
    top = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), column)
        .first()
    )
    if top is None:
        raise ValueError(f"no values to take the mode of: {column}")
    return top[column]


def fill(
    df: DataFrame, strategies: Mapping[str, object], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Apply one strategy per column in the given order; unknown columns are skipped.

    ``mean``, ``median``, ``mode``, ``drop``, ``forward_fill``, ``backward_fill``; any other value
    fills in as it is. Steps between two ``drop`` steps do not affect each other, so their
    statistics come from one shared pass; a ``drop`` changes what later steps see.
    ``order_by`` must order rows uniquely and is required by the directional fills.
    """
    pending: list[tuple[str, object]] = []
    for column, method in strategies.items():
        if column not in df.columns:
            continue
        if method == "drop":
            df = _fill_group(df, pending, order_by).na.drop(subset=[column])
            pending = []
        else:
            pending.append((column, method))
    return _fill_group(df, pending, order_by)


def _fill_group(df: DataFrame, steps: list[tuple[str, object]], order_by) -> DataFrame:
    if not steps:
        return df
    values: dict[str, object] = {}
    means = [c for c, m in steps if m == "mean"]
    medians = [c for c, m in steps if m == "median"]
    averages = [F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(means)]
    if averages or medians:
        row, middle = column_quantiles(df, medians, (0.5,), averages)
        values.update({c: row[f"m{i}"] for i, c in enumerate(means)})
        values.update({c: found[0] for c, found in middle.items()})
    for column, method in steps:
        if method == "mode":
            values[column] = most_frequent(df, column)
        elif method not in STATISTICS + DIRECTIONS:
            values[column] = method
    filled = {}
    for column, value in values.items():
        if value is None:
            continue
        kind = df.schema[column].dataType
        wide = isinstance(value, float) and isinstance(kind, T.IntegralType)
        filled[column] = F.coalesce(F.col(column).cast("double") if wide else F.col(column), F.lit(value))
    df = df.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])
    moves = {c: m for c, m in steps if m in DIRECTIONS}
    return directional_fill(df, moves, order_by) if moves else df


def directional_fill(
    df: DataFrame,
    moves: Mapping[str, str],
    order_by: Sequence[str] | None,
    blocks: int | None = None,
) -> DataFrame:
    """Carry the previous or next known value in ``order_by`` order, null keys first.

    The order is cut into ranges. Each range contributes its first and last known value; those few
    rows, one per range, are carried across ranges, then every range is filled on its own.
    """
    if not order_by:
        raise ValueError("forward and backward fill need order_by")
    blocked = range_blocks(df, list(order_by), blocks)
    order = F.struct(*[F.col(c) for c in order_by])
    ends = []
    for i, (c, move) in enumerate(moves.items()):
        known = F.when(F.col(c).isNotNull(), order)
        pick = F.max_by if move == "forward_fill" else F.min_by
        ends.append(pick(F.col(c), known).alias(f"__end_{i}"))
    per_block = blocked.groupBy(BLOCK).agg(*ends)
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        BLOCK,
        *[
            (
                F.last(f"__end_{i}", ignorenulls=True).over(before)
                if m == "forward_fill"
                else F.last(f"__end_{i}", ignorenulls=True).over(after)
            ).alias(f"__carry_{i}")
            for i, m in enumerate(moves.values())
        ],
    )
    # a frame running back to the range's start is updated row by row; one running ahead is not,
    # so the previous-value frame is also used for the next value, over the reversed order
    inside = Window.partitionBy(BLOCK)
    forward = inside.orderBy(*[F.asc_nulls_first(c) for c in order_by]).rowsBetween(Window.unboundedPreceding, 0)
    backward = inside.orderBy(*[F.desc_nulls_last(c) for c in order_by]).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for i, (c, m) in enumerate(moves.items()):
        near = F.last(c, ignorenulls=True).over(forward if m == "forward_fill" else backward)
        filled[c] = F.coalesce(near, F.col(f"__carry_{i}"))
    joined = blocked.join(carry, BLOCK)
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])

"""From a cleaned table to model-ready splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import features


def prepare(
    df: DataFrame,
    target: str,
    key: str,
    columns: Sequence[str] | None = None,
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    scaling: bool = True,
) -> DataFrame:
    """Split, then scale the feature columns with statistics of the training rows."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in (target, key)]
    parted = features.split(df, target, key, test_size, val_size, seed)
    return features.scale(parted, columns) if scaling else parted

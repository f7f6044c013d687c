"""Batch scoring into the shared predictions table.

A scorer is any object with ``name`` and ``attach(df, features, column)`` that adds an
``array<double>`` of class probabilities. Several scorers are attached to one frame, so a
table is scanned once however many models are scored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


def attach_all(scorers: Sequence, df: DataFrame, features: Sequence[str], prefix: str) -> DataFrame:
    for i, scorer in enumerate(scorers):
        df = scorer.attach(df, list(features), f"{prefix}{i}")
    return df


def score(
    scorers: Sequence,
    df: DataFrame,
    features: Sequence[str],
    key: str = "row_id",
    target: str = "y",
    split: str = "split",
) -> DataFrame:
    """predictions(model, model_seq, split, row_id, y_true, y_pred, proba)."""
    scored = attach_all(scorers, df, features, "__proba_")
    per_model = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("model"),
                F.lit(i).alias("model_seq"),
                F.col(f"__proba_{i}").alias("proba"),
            )
            for i, s in enumerate(scorers)
        ]
    )
    long = scored.select(
        F.col(split).alias("split"),
        F.col(key).alias("row_id"),
        F.col(target).cast("int").alias("y_true"),
        F.inline(per_model),
    )
    return long.select(
        "model",
        "model_seq",
        "split",
        "row_id",
        "y_true",
        arrays.argmax(F.col("proba")).alias("y_pred"),
        "proba",
    )

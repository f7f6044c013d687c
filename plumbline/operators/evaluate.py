"""Classification metrics from confusion counts.

The only pass over the data is ``confusion_counts``; it combines map-side into at most k*k
rows per key. Everything else works on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import KEYS

METRICS = ("accuracy", "precision", "recall", "f1")


def confusion_counts(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def label_counts(
    confusion: DataFrame, keys: Sequence[str] = KEYS, carry: Sequence[str] = ()
) -> DataFrame:
    """(keys, label, support, predicted, hits) over the union of true and predicted labels.

    ``carry`` names further additive columns of ``confusion``; each is counted on one side only.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
            hit.cast("bigint").alias("hits"),
            *[F.col(c).alias(c) for c in carry],
        ),
        F.struct(
            F.col("y_pred").alias("label"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
            zero.alias("hits"),
            *[zero.alias(c) for c in carry],
        ),
    )
    return (
        confusion.select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("hits").alias("hits"),
            *[F.sum(c).alias(c) for c in carry],
        )
    )


def class_metrics(
    confusion: DataFrame, keys: Sequence[str] = KEYS, carry: Sequence[str] = ()
) -> DataFrame:
    """Per-class precision, recall, F1 and support; an undefined ratio counts as 0."""
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return label_counts(confusion, keys, carry).select(
        *keys,
        "label",
        "support",
        "hits",
        _ratio(hits, predicted).alias("precision"),
        _ratio(hits, support).alias("recall"),
        _ratio(F.lit(2.0) * hits, support + predicted).alias("f1"),
        *carry,
    )


def metrics_from_confusion(
    confusion: DataFrame, keys: Sequence[str] = KEYS, carry: Sequence[str] = ()
) -> DataFrame:
    """Accuracy plus support-weighted precision, recall and F1 per key."""
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return (F.sum(F.col("support") * F.col(name)) / total).alias(name)

    return (
        class_metrics(confusion, keys, carry)
        .groupBy(*keys)
        .agg(
            (F.sum("hits") / total).alias("accuracy"),
            weighted("precision"),
            weighted("recall"),
            weighted("f1"),
            total.alias("n"),
            *[F.sum(c).alias(c) for c in carry],
        )
    )


def metrics(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return metrics_from_confusion(confusion_counts(pred, keys), keys)


def confusion_matrix(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every (true, predicted) pair over the union of labels of the key, zeros included.

    The dense form has a cell per pair of labels; with many labels use ``confusion_counts``, which has the cells that
    occur. The predictions are read once: each label's row of counts is put beside one zero per label of the key, and
    the two are summed.
    """
    counts = confusion_counts(pred, keys)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.struct(F.col("y_pred"), F.col("n")).alias("cell")),
        F.struct(F.col("y_pred").alias("label"), F.lit(None).alias("cell")),
    )
    rows = counts.select(*keys, F.inline(sides)).groupBy(*keys, "label").agg(F.collect_list("cell").alias("cells"))
    every = F.collect_list(F.struct(F.col("label").alias("y_pred"), F.lit(0).cast("bigint").alias("n")))
    filled = rows.withColumn("zeros", every.over(Window.partitionBy(*keys)))
    cells = filled.select(*keys, F.col("label").alias("y_true"), F.inline(F.concat("cells", "zeros")))
    return cells.groupBy(*keys, "y_true", "y_pred").agg(F.sum("n").alias("n"))


def confusion_wide(pred: DataFrame, labels: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per true label with a column per predicted label."""
    return (
        confusion_matrix(pred, keys)
        .groupBy(*keys, "y_true")
        .pivot("y_pred", list(labels))
        .agg(F.first("n"))
        .select(
            *keys, "y_true", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"pred_{c}") for c in labels]
        )
    )


def report(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per-class rows, then ``accuracy``, ``macro avg`` and ``weighted avg``.

    The accuracy row repeats its value in every column, as a transposed report shows it.
    """
    by_class = class_metrics(confusion_counts(pred, keys), keys)
    names = ("precision", "recall", "f1", "support")
    rows = by_class.select(
        *keys,
        F.col("label").cast("string").alias("label"),
        "precision",
        "recall",
        "f1",
        F.col("support").cast("double").alias("support"),
    )
    total = F.sum("support")
    rolled = by_class.groupBy(*keys).agg(
        (F.sum("hits") / total).alias("acc"),
        total.cast("double").alias("support"),
        *[F.avg(c).alias(f"macro_{c}") for c in names[:3]],
        *[(F.sum(F.col("support") * F.col(c)) / total).alias(f"weighted_{c}") for c in names[:3]],
    )

    def entry(label: str, cols: list[Column]) -> Column:
        return F.struct(F.lit(label).alias("label"), *[c.alias(n) for c, n in zip(cols, names)])

    summary = F.array(
        entry("accuracy", [F.col("acc")] * 4),
        entry("macro avg", [F.col(f"macro_{c}") for c in names[:3]] + [F.col("support")]),
        entry("weighted avg", [F.col(f"weighted_{c}") for c in names[:3]] + [F.col("support")]),
    )
    return rows.unionByName(rolled.select(*keys, F.inline(summary)))


def best(metric_table: DataFrame, metric: str = "accuracy", split: str = "test") -> DataFrame:
    """Highest value of one metric on one split; the first trained model wins a tie."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return (
        metric_table.filter(F.col("split") == split)
        .orderBy(F.desc(metric), "model_seq")
        .limit(1)
        .select("model", F.col(metric).alias("score"))
    )


def summary(metric_table: DataFrame) -> DataFrame:
    """Formatted model x split table."""
    return metric_table.select(
        "model",
        F.initcap("split").alias("dataset"),
        *[text.fixed(F.col(c), 4).alias(c) for c in METRICS],
    )


def metric_series(metric_table: DataFrame, split: str = "test") -> DataFrame:
    """Chart data: one row per model and metric of a split."""
    return metric_table.filter(F.col("split") == split).unpivot(
        ["model"], list(METRICS), "metric", "value"
    )


def probabilities(pred: DataFrame, model: str, split: str = "test") -> DataFrame:
    """Stored class probabilities of one model and split."""
    return pred.filter((F.col("model") == model) & (F.col("split") == split)).select("row_id", "proba")

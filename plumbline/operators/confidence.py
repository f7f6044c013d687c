"""Confidence and uncertainty of predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, binning
from . import KEYS
from .order_stats import quantiles


def with_confidence(pred: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Predictions plus ``confidence``, ``correct`` and ``entropy``."""
    return pred.select(
        "*",
        arrays.confidence(F.col("proba")).alias("confidence"),
        (F.col("y_true") == F.col("y_pred")).alias("correct"),
        arrays.entropy(F.col("proba"), n_classes).alias("entropy"),
    )


def confidence_frame(pred: DataFrame) -> DataFrame:
    """True label, predicted label, confidence, correctness."""
    return pred.select(
        "model",
        "split",
        "row_id",
        F.col("y_true").alias("true_label"),
        F.col("y_pred").alias("predicted_label"),
        arrays.confidence(F.col("proba")).alias("confidence"),
        (F.col("y_true") == F.col("y_pred")).alias("correct"),
    )


def binned(pred: DataFrame, n_bins: int = 10) -> DataFrame:
    """Confidence and its bin number per row."""
    return pred.select(
        "model", "split", "row_id", arrays.confidence(F.col("proba")).alias("confidence")
    ).withColumn("bin", binning.bin_index(F.col("confidence"), n_bins))


def high_confidence_errors(pred: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Detail rows: wrong and at least ``threshold`` confident."""
    return confidence_frame(pred).filter(~F.col("correct") & (F.col("confidence") >= F.lit(threshold)))


def high_confidence_error_summary(
    pred: DataFrame, threshold: float = 0.8, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Count, percentage of all rows and mean confidence (0 when there are none)."""
    frame = confidence_frame(pred)
    wrong = ~F.col("correct") & (F.col("confidence") >= F.lit(threshold))
    n = F.count(F.when(wrong, F.lit(1)))
    return frame.groupBy(*keys).agg(
        n.alias("error_count"),
        (n / F.count(F.lit(1)) * F.lit(100.0)).alias("error_pct"),
        F.coalesce(F.avg(F.when(wrong, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
    )


def errors_by_class(pred: DataFrame, threshold: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    """High-confidence errors per true class, largest first."""
    return (
        high_confidence_errors(pred, threshold)
        .groupBy(*keys, "true_label")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), *keys, "true_label")
    )


def brier(pred: DataFrame, keys: Sequence[str] = KEYS, n_classes: int | None = None) -> DataFrame:
    """Mean squared distance to the one-hot label, between 0 and 2."""
    return pred.groupBy(*keys).agg(
        F.avg(arrays.squared_error(F.col("proba"), F.col("y_true"), n_classes)).alias("brier")
    )


def overview(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return (
        confidence_frame(pred)
        .groupBy(*keys)
        .agg(
            F.avg(F.col("correct").cast("int")).alias("accuracy"),
            F.avg("confidence").alias("avg_confidence"),
            F.avg(F.when(F.col("correct"), F.col("confidence"))).alias("avg_confidence_correct"),
        )
    )


def threshold_split(pred: DataFrame, threshold: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Row count and accuracy at or above the threshold and below it."""
    frame = confidence_frame(pred).withColumn(
        "level", F.when(F.col("confidence") >= F.lit(threshold), F.lit("high")).otherwise(F.lit("low"))
    )
    return frame.groupBy(*keys, "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )


def entropy_stats(pred: DataFrame, keys: Sequence[str] = KEYS, n_classes: int | None = None) -> DataFrame:
    return (
        pred.select(*keys, arrays.entropy(F.col("proba"), n_classes).alias("entropy"))
        .groupBy(*keys)
        .agg(
            F.avg("entropy").alias("mean_entropy"),
            F.max("entropy").alias("max_entropy"),
            F.min("entropy").alias("min_entropy"),
            F.stddev_pop("entropy").alias("std_entropy"),
        )
    )


def most_uncertain(
    pred: DataFrame, model: str, split: str = "test", n: int = 10, n_classes: int | None = None
) -> DataFrame:
    """The ``n`` rows of one model and split with the largest entropy, lowest key first on ties."""
    return (
        with_confidence(
            pred.filter((F.col("model") == model) & (F.col("split") == split)), n_classes
        )
        .orderBy(F.desc("entropy"), "row_id")
        .limit(n)
        .select(
            "row_id",
            F.col("y_true").alias("true_label"),
            F.col("y_pred").alias("predicted_label"),
            "confidence",
            "entropy",
            "correct",
        )
    )


def confidence_histogram(pred: DataFrame, n_bins: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Row counts per correctness and fixed-width confidence slot over [0, 1]."""
    return (
        confidence_frame(pred)
        .withColumn("bin", binning.bin_index(F.col("confidence"), n_bins))
        .groupBy(*keys, "correct", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def entropy_histogram(
    pred: DataFrame, n_classes: int, n_bins: int = 30, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Row counts per correctness and fixed-width entropy slot over [0, ln k]."""
    top = math.log(n_classes)
    return (
        with_confidence(pred, n_classes)
        .withColumn("bin", binning.width_index(F.col("entropy"), 0.0, top, n_bins))
        .groupBy(*keys, "correct", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confidence_by_class(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Box-plot data of the confidence per predicted class: exact quartiles, mean, deviation."""
    by = [*keys, "y_pred"]
    frame = pred.select(*by, arrays.confidence(F.col("proba")).alias("confidence"))
    stats = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("confidence").alias("mean"),
        F.stddev_pop("confidence").alias("std"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
    )
    quartiles = quantiles(frame, by, "confidence", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return stats.join(quartiles, by)


def accuracy_curve(pred: DataFrame, n_bins: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bin centre, accuracy (0 when the bin is empty) and count for every bin."""
    counts = (
        confidence_frame(pred)
        .withColumn("bin", binning.bin_index(F.col("confidence"), n_bins))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("hits"))
    )
    centres = [(a + b) / 2 for a, b in zip(binning.edges(n_bins)[:-1], binning.edges(n_bins)[1:])]
    return every_bin(counts, keys, n_bins, ("n", "hits")).select(
        *keys,
        "bin",
        F.get(F.array(*[F.lit(c) for c in centres]), F.col("bin")).alias("centre"),
        F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(0.0)).alias("accuracy"),
        "n",
    )


def every_bin(counts: DataFrame, keys: Sequence[str], n_bins: int, sums: Sequence[str]) -> DataFrame:
    """Add a zero row for each empty bin: a key's bins, at most ``n_bins``, become one map that all bins look up.

    ``counts`` is read once.
    """
    found = F.map_from_entries(F.collect_list(F.struct("bin", F.struct(*sums))))
    each = counts.groupBy(*keys).agg(found.alias("__bins"))
    each = each.select(*keys, "__bins", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    at = F.try_element_at("__bins", F.col("bin"))
    zero = {c: F.lit(0).cast(counts.schema[c].dataType) for c in sums}
    return each.select(*keys, "bin", *[F.coalesce(at.getField(c), zero[c]).alias(c) for c in sums])


def error_table(pred: DataFrame, threshold: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts of correct and wrong rows at or above and below the threshold."""
    high = F.col("confidence") >= F.lit(threshold)

    def tally(cond):
        return F.count(F.when(cond, F.lit(1)))

    return (
        confidence_frame(pred)
        .groupBy(*keys)
        .agg(
            tally(F.col("correct") & high).alias("high_correct"),
            tally(~F.col("correct") & high).alias("high_errors"),
            tally(F.col("correct") & ~high).alias("low_correct"),
            tally(~F.col("correct") & ~high).alias("low_errors"),
        )
    )

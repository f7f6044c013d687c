"""Calibration: binned confidence against accuracy, Brier score, temperature scaling.

One pass over the predictions produces a (keys, bin) table of counts and sums; ECE, MCE and
the averages are taken from that table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, bands, binning
from . import KEYS
from .confidence import every_bin

# The temperature grid of the search.
TEMPERATURES = [float(t) for t in np.arange(0.1, 5.1, 0.1)]

MEASURES = ("ece", "mce", "brier", "avg_confidence", "avg_accuracy", "overconfidence")


def bin_sums(
    pred: DataFrame, keys: Sequence[str] = KEYS, n_bins: int = 10, n_classes: int | None = None
) -> DataFrame:
    """(keys, bin, n, hits, conf_sum, brier_sum), populated bins only."""
    rows = pred.select(
        *keys,
        arrays.confidence(F.col("proba")).alias("confidence"),
        (arrays.argmax(F.col("proba")) == F.col("y_true")).cast("int").alias("hit"),
        arrays.squared_error(F.col("proba"), F.col("y_true"), n_classes).alias("error"),
    )
    return (
        rows.withColumn("bin", binning.bin_index(F.col("confidence"), n_bins))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("hit").alias("hits"),
            F.sum("confidence").alias("conf_sum"),
            F.sum("error").alias("brier_sum"),
        )
    )


def metrics_from_bins(sums: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    gap = F.abs(F.col("hits") - F.col("conf_sum"))
    total = F.sum("n")
    return (
        sums.groupBy(*keys)
        .agg(
            (F.sum(gap) / total).alias("ece"),
            F.max(gap / F.col("n")).alias("mce"),
            (F.sum("brier_sum") / total).alias("brier"),
            (F.sum("conf_sum") / total).alias("avg_confidence"),
            (F.sum("hits") / total).alias("avg_accuracy"),
            total.alias("n"),
        )
        .withColumn("overconfidence", F.col("avg_confidence") - F.col("avg_accuracy"))
    )


def metrics(
    pred: DataFrame, keys: Sequence[str] = KEYS, n_bins: int = 10, n_classes: int | None = None
) -> DataFrame:
    """ECE, MCE, Brier, average confidence and accuracy, overconfidence per key."""
    return metrics_from_bins(bin_sums(pred, keys, n_bins, n_classes), keys)


def bins(
    pred: DataFrame, keys: Sequence[str] = KEYS, n_bins: int = 10, n_classes: int | None = None
) -> DataFrame:
    """calibration_bins(keys, bin, lo, hi, n, acc, conf) with zero rows for empty bins."""
    sums = bin_sums(pred, keys, n_bins, n_classes).drop("brier_sum")
    n = F.col("n")
    return every_bin(sums, keys, n_bins, ("n", "hits", "conf_sum")).select(
        *keys,
        "bin",
        binning.edge_at(F.col("bin"), n_bins).alias("lo"),
        binning.edge_at(F.col("bin") + F.lit(1), n_bins).alias("hi"),
        "n",
        F.when(n > 0, F.col("hits") / n).otherwise(F.lit(0.0)).alias("acc"),
        F.when(n > 0, F.col("conf_sum") / n).otherwise(F.lit(0.0)).alias("conf"),
    )


def per_class(
    pred: DataFrame,
    keys: Sequence[str] = KEYS,
    n_bins: int = 10,
    class_names: Sequence[str] | None = None,
) -> DataFrame:
    """One-vs-rest ECE, Brier, mean probability and prevalence, rounded to 4 digits."""
    rows = pred.select(*keys, "y_true", F.posexplode("proba").alias("class_index", "p")).select(
        *keys,
        "class_index",
        "p",
        (F.col("y_true") == F.col("class_index")).cast("int").alias("hit"),
    )
    gap = F.col("p") - F.col("hit")
    sums = (
        rows.withColumn("bin", binning.bin_index(F.col("p"), n_bins))
        .groupBy(*keys, "class_index", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("hit").alias("hits"),
            F.sum("p").alias("p_sum"),
            F.sum(gap * gap).alias("error_sum"),
        )
    )
    total = F.sum("n")
    default = F.concat(F.lit("Class "), F.col("class_index").cast("string"))
    if class_names:
        names = F.array(*[F.lit(c) for c in class_names])
        label = F.coalesce(F.get(names, F.col("class_index")), default)
    else:
        label = default
    return (
        sums.groupBy(*keys, "class_index")
        .agg(
            F.round(F.sum(F.abs(F.col("hits") - F.col("p_sum"))) / total, 4).alias("ece"),
            F.round(F.sum("error_sum") / total, 4).alias("brier"),
            F.round(F.sum("p_sum") / total, 4).alias("avg_probability"),
            F.round(F.sum("hits") / total, 4).alias("prevalence"),
        )
        .select(*keys, "class_index", label.alias("class_name"), "ece", "brier", "avg_probability", "prevalence")
    )


def scale(pred: DataFrame, temperature: float, n_classes: int | None = None) -> DataFrame:
    """Predictions with tempered probabilities."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    return pred.withColumn("proba", arrays.tempered(F.col("proba"), F.lit(float(temperature)), n_classes))


def temperature_search(
    pred: DataFrame,
    keys: Sequence[str] = KEYS,
    temperatures: Sequence[float] = tuple(TEMPERATURES),
    n_bins: int = 10,
    n_classes: int | None = None,
) -> DataFrame:
    """ECE of every temperature of the grid, from one scan.

    The grid is a constant array exploded inside the stage and combined map-side, so only
    len(grid) * n_bins rows per key are shuffled.
    """
    rows = pred.select(
        *keys,
        (arrays.argmax(F.col("proba")) == F.col("y_true")).cast("int").alias("hit"),
        arrays.log_gaps(F.col("proba"), n_classes).alias("gaps"),
    )
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    expanded = rows.select("*", F.explode(grid).alias("temperature")).select(
        *keys,
        "temperature",
        "hit",
        arrays.tempered_confidence(F.col("gaps"), F.col("temperature"), n_classes).alias("confidence"),
    )
    by = [*keys, "temperature"]
    sums = (
        expanded.withColumn("bin", binning.bin_index(F.col("confidence"), n_bins))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("hit").alias("hits"),
            F.sum("confidence").alias("conf_sum"),
        )
    )
    gap = F.abs(F.col("hits") - F.col("conf_sum"))
    return sums.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def best_temperature(search: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Temperature with the least ECE, the smaller one on ties, rounded to 2 digits."""
    return search.groupBy(*keys).agg(
        F.min(F.struct("ece", "temperature")).alias("top")
    ).select(*keys, F.round("top.temperature", 2).alias("temperature"), F.col("top.ece").alias("ece"))


def with_quality(measures: DataFrame) -> DataFrame:
    return measures.withColumn("quality", bands.calibration_quality(F.col("ece")))


def table(measures: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rounded metric table with the quality of the unrounded ECE."""
    return measures.select(
        *keys,
        *[F.round(c, 4).alias(c) for c in MEASURES],
        bands.calibration_quality(F.col("ece")).alias("quality"),
    )


def best_calibrated(measures: DataFrame, split: str = "test") -> DataFrame:
    """Model with the least ECE on a split; the first trained one on ties."""
    return (
        measures.filter(F.col("split") == split)
        .orderBy("ece", "model_seq")
        .limit(1)
        .select("model", "ece")
    )


def worst_class(per_class_table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Class with the largest rounded ECE per key, the first one on ties."""
    order = F.struct("ece", (-F.col("class_index")).alias("rank"))
    return per_class_table.groupBy(*keys).agg(
        F.max_by("class_name", order).alias("class_name"), F.max("ece").alias("ece")
    )


def diagram(bin_table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reliability-diagram data: populated bins, marker size, gap box, over-confidence flag."""
    top = F.max("n").over(Window.partitionBy(*keys))  # over the few bins of a key
    return (
        bin_table.filter(F.col("n") > 0)
        .withColumn("top", top)
        .select(
            *keys,
            "bin",
            F.col("lo").alias("x0"),
            F.col("hi").alias("x1"),
            "conf",
            "acc",
            (F.col("n") / F.col("top") * F.lit(20.0) + F.lit(6.0)).alias("marker_size"),
            F.least("conf", "acc").alias("y0"),
            F.greatest("conf", "acc").alias("y1"),
            (F.col("conf") > F.col("acc")).alias("overconfident"),
        )
    )


def before_after(
    pred: DataFrame,
    temperature: float,
    keys: Sequence[str] = KEYS,
    n_bins: int = 10,
    n_classes: int | None = None,
) -> DataFrame:
    """ECE, MCE, Brier and quality with and without temperature scaling, from one scan."""
    pair = pred.select(
        *keys,
        "y_true",
        F.inline(
            F.array(
                F.struct(F.lit("before").alias("stage"), F.col("proba")),
                F.struct(
                    F.lit("after").alias("stage"),
                    arrays.tempered(F.col("proba"), F.lit(float(temperature)), n_classes).alias("proba"),
                ),
            )
        ),
    )
    measures = metrics(pair, [*keys, "stage"], n_bins, n_classes)

    def at(stage: str, name: str):
        return F.max(F.when(F.col("stage") == stage, F.col(name)))

    names = ("ece", "mce", "brier")
    wide = measures.groupBy(*keys).agg(
        *[at("before", c).alias(f"{c}_before") for c in names],
        *[at("after", c).alias(f"{c}_after") for c in names],
    )
    return wide.select(
        "*",
        *[(F.col(f"{c}_after") - F.col(f"{c}_before")).alias(f"{c}_delta") for c in names],
        bands.calibration_quality(F.col("ece_before")).alias("quality_before"),
        bands.calibration_quality(F.col("ece_after")).alias("quality_after"),
    )


def comparison(measures: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Chart data: ECE, MCE and Brier per key in long form."""
    return measures.select(*keys, "ece", "mce", "brier").unpivot(
        list(keys), ["ece", "mce", "brier"], "measure", "value"
    )

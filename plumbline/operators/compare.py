"""Side-by-side comparison of models: composite score, ranking, display tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bands, text
from ..functions.rounding import nearest
from . import evaluate

# Points per part of the composite score.
PERFORMANCE_POINTS = 50.0
ROBUSTNESS_POINTS = 25.0
CALIBRATION_POINTS = 25.0

METRICS = evaluate.METRICS


def performance(models: DataFrame, metric_table: DataFrame, split: str = "test") -> DataFrame:
    """Every trained model with its rounded metrics on a split, or nulls and has_data = false."""
    found = metric_table.filter(F.col("split") == split).select(
        "model", *[F.round(c, 4).alias(c) for c in METRICS], F.lit(True).alias("has_data")
    )
    return (
        models.select("model", "model_seq")
        .join(found, "model", "left")
        .withColumn("has_data", F.coalesce("has_data", F.lit(False)))
    )


def confusion_by_model(pred: DataFrame, split: str = "test") -> DataFrame:
    """Confusion matrix of every model with predictions on the split."""
    return evaluate.confusion_matrix(pred.filter(F.col("split") == split), ("model",))


def linear_robustness(results: DataFrame) -> DataFrame:
    """100 minus the mean accuracy drop in points, not below 0, rounded to 2 digits."""
    return results.groupBy("model").agg(
        F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.avg("performance_drop") * F.lit(100.0)), 2).alias(
            "robustness"
        )
    )


def composite(performances: DataFrame, robustness: DataFrame | None = None, ece: DataFrame | None = None) -> DataFrame:
    """Composite score of models with metrics; points of an absent part go to performance.

    ``robustness``(model, robustness) and ``ece``(model, ece) may be missing as a whole or for
    single models.
    """
    table = performances.filter("has_data")
    table = (
        table.join(robustness.select("model", "robustness"), "model", "left")
        if robustness is not None
        else table.withColumn("robustness", F.lit(None).cast("double"))
    )
    table = (
        table.join(ece.select("model", "ece"), "model", "left")
        if ece is not None
        else table.withColumn("ece", F.lit(None).cast("double"))
    )
    perf = (F.col("accuracy") + F.col("f1")) / F.lit(2.0)
    rob, cal = F.col("robustness"), F.col("ece")
    total = (
        perf * F.lit(PERFORMANCE_POINTS)
        + F.when(rob.isNull(), perf * F.lit(ROBUSTNESS_POINTS)).otherwise(rob / F.lit(100.0) * F.lit(ROBUSTNESS_POINTS))
        + F.when(cal.isNull(), perf * F.lit(CALIBRATION_POINTS)).otherwise(
            F.greatest(F.lit(0.0), F.lit(1.0) - cal) * F.lit(CALIBRATION_POINTS)
        )
    )
    return table.withColumn("composite", F.least(total, F.lit(100.0))).withColumn(
        "composite", F.expr(nearest("composite", 2))
    )


def ranked(composites: DataFrame) -> DataFrame:
    """Rank 1 is the best composite; the first trained model wins a tie. One row per model."""
    order = Window.orderBy(F.desc("composite"), "model_seq")
    return composites.withColumn("rank", F.row_number().over(order))


def recommend(composites: DataFrame) -> DataFrame:
    """Best model, its score, the runner-up and the reason text; one row, empty without scores."""
    order = F.struct("composite", (-F.col("model_seq")).alias("s"))
    top_two = (
        ranked(composites)
        .filter(F.col("rank") <= 2)
        .agg(
            F.max_by("model", order).alias("best_model"),
            *[F.max_by(c, order).alias(c) for c in ("composite", "accuracy", "f1", "robustness")],
            F.max(F.when(F.col("rank") == 2, F.struct("model", "composite"))).alias("second"),
        )
        .filter(F.col("best_model").isNotNull())
    )
    lines = [
        F.concat(
            F.lit("**"),
            F.col("best_model"),
            F.lit("** achieves the highest composite score of **"),
            text.fixed(F.col("composite"), 1),
            F.lit("/100**."),
        ),
        F.concat(F.lit("- Accuracy: "), text.fixed(F.col("accuracy"), 3)),
        F.concat(F.lit("- F1 Score: "), text.fixed(F.col("f1"), 3)),
        F.concat(F.lit("- Robustness Score: "), text.fixed(F.col("robustness"), 1), F.lit("/100")),
        F.concat(
            F.lit("\nRunner-up: **"),
            F.col("second.model"),
            F.lit("** (composite score "),
            text.fixed(F.col("second.composite"), 1),
            F.lit("/100)"),
        ),
    ]
    return top_two.select(
        "best_model",
        F.col("composite").alias("composite_score"),
        F.col("second.model").alias("runner_up"),
        F.array_join(F.array_compact(F.array(*lines)), "\n").alias("reason"),
    )


def metric_table(performances: DataFrame) -> DataFrame:
    """Formatted metrics of the models that have them."""
    return performances.filter("has_data").select("model", *[text.fixed(F.col(c), 4).alias(c) for c in METRICS])


def ranking_table(composites: DataFrame) -> DataFrame:
    """Rank, formatted composite, accuracy and F1, robustness and ECE where known."""
    return ranked(composites).select(
        "rank",
        "model",
        text.fixed(F.col("composite"), 1).alias("composite"),
        text.fixed(F.col("accuracy"), 4).alias("accuracy"),
        text.fixed(F.col("f1"), 4).alias("f1"),
        text.fixed(F.col("robustness"), 1).alias("robustness"),
        text.fixed(F.col("ece"), 4).alias("ece"),
    )


def class_accuracy(pred: DataFrame, models: Sequence[str], split: str = "test") -> DataFrame:
    """Class x model table of the share of each true class predicted right."""
    counts = evaluate.confusion_counts(pred.filter(F.col("split") == split), ("model",))
    by_class = evaluate.label_counts(counts, ("model",)).select(
        "model",
        F.col("label").alias("class"),
        text.fixed(F.col("hits") / F.greatest(F.col("support"), F.lit(1)), 3).alias("accuracy"),
    )
    return by_class.groupBy("class").pivot("model", list(models)).agg(F.first("accuracy"))


def robustness_rating(robustness: DataFrame) -> DataFrame:
    """Formatted score and rating, best first."""
    return (
        robustness.orderBy(F.desc("robustness"), "model")
        .select(
            "model",
            text.fixed(F.col("robustness"), 1, " / 100").alias("score"),
            bands.rating(F.col("robustness")).alias("rating"),
        )
    )


def ece_table(ece: DataFrame) -> DataFrame:
    """Formatted ECE and quality, best first."""
    return ece.orderBy("ece", "model").select(
        "model",
        text.fixed(F.col("ece"), 4).alias("ece"),
        bands.calibration_quality(F.col("ece")).alias("quality"),
    )


def metric_series(performances: DataFrame) -> DataFrame:
    """Chart data for bars and radar: one row per model and metric."""
    return performances.filter("has_data").unpivot(["model"], list(METRICS), "metric", "value")


def composite_series(composites: DataFrame) -> DataFrame:
    """Chart data: composite per model, best first."""
    return composites.orderBy(F.desc("composite"), "model_seq").select("model", "composite")

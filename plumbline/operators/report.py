"""Report sections and summary figures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands
from . import evaluate

UNKNOWN = "N/A"
STAMP = "yyyy-MM-dd HH:mm:ss"


def performance(models: DataFrame, metric_table: DataFrame, split: str = "test") -> DataFrame:
    """Rounded metrics of the models that have them on the split."""
    found = metric_table.filter(F.col("split") == split).drop("model_seq")
    return models.join(found, "model").select(
        F.col("model").alias("Model"), *[F.round(c, 4).alias(c.capitalize()) for c in evaluate.METRICS]
    )


def robustness(models: DataFrame, results: DataFrame) -> DataFrame:
    """Original and stressed accuracy and drop per listed model and test."""
    return models.select("model").join(results, "model").select(
        F.col("model").alias("Model"),
        F.col("test_name").alias("Stress Type"),
        F.round("accuracy_original", 4).alias("Orig Acc"),
        F.round("accuracy_stressed", 4).alias("Stress Acc"),
        F.round("performance_drop", 4).alias("Drop"),
        F.round("performance_drop_pct", 2).alias("Drop %"),
    )


def calibration(models: DataFrame, ece: DataFrame) -> DataFrame:
    """Rounded ECE with the quality of the unrounded one."""
    return models.select("model").join(ece, "model").filter(F.col("ece").isNotNull()).select(
        F.col("model").alias("Model"),
        F.round("ece", 4).alias("ECE"),
        bands.calibration_quality(F.col("ece")).alias("Quality"),
    )


def reliability(models: DataFrame, scores: DataFrame) -> DataFrame:
    return models.select("model").join(scores, "model").select(
        F.col("model").alias("Model"),
        *[
            F.col(c.lower()).alias(c)
            for c in ("Total", "Grade", "Performance", "Calibration", "Robustness", "Confidence")
        ],
    )


def summary(models: DataFrame, sections: Mapping[str, DataFrame]) -> DataFrame:
    """Best models and counts over the sections; one row.

    Each section is rolled up per model and joined to the model list, then one aggregate picks the
    winners; the first trained model wins a tie.
    """
    table = models.select("model", "model_seq")
    rolled = {
        "performance": lambda s: s.select(F.col("Model").alias("model"), F.col("F1").alias("best_f1")),
        "reliability": lambda s: s.select(F.col("Model").alias("model"), F.col("Total").alias("best_total")),
        "robustness": lambda s: s.groupBy(F.col("Model").alias("model")).agg(F.avg("Drop").alias("mean_drop")),
        "calibration": lambda s: s.select(F.col("Model").alias("model"), F.col("ECE").alias("known_ece")),
    }
    names = {"performance": "best_f1", "reliability": "best_total", "robustness": "mean_drop", "calibration": "known_ece"}
    for section, roll in rolled.items():
        if section in sections:
            table = table.join(roll(sections[section]), "model", "left")
        else:
            table = table.withColumn(names[section], F.lit(None).cast("double"))

    def winner(value: str, sign: int):
        known = F.when(F.col(value).isNotNull(), F.struct((F.col(value) * F.lit(sign)).alias("v"), (-F.col("model_seq")).alias("s")))
        return F.coalesce(F.max_by("model", known), F.lit(UNKNOWN))

    return table.agg(
        winner("best_f1", 1).alias("best_performance"),
        winner("best_total", 1).alias("best_reliability"),
        winner("mean_drop", -1).alias("most_robust"),
        F.count(F.lit(1)).alias("num_models"),
        F.count("mean_drop").alias("num_stressed"),
        F.count("known_ece").alias("num_calibrated"),
    )


def heatmap(robustness_section: DataFrame, tests: list[str] | None = None) -> DataFrame:
    """Models x tests table of the rounded drop, null where a model was not tested.

    ``tests`` names the columns; without it the distinct tests are read first.
    """
    pivot = robustness_section.groupBy("Model")
    pivoted = pivot.pivot("Stress Type", sorted(tests)) if tests else pivot.pivot("Stress Type")
    return pivoted.agg(F.first("Drop")).orderBy("Model")


def performance_series(section: DataFrame) -> DataFrame:
    """Chart data: metric bars."""
    return section.unpivot(["Model"], ["Accuracy", "Precision", "Recall", "F1"], "metric", "value")


def calibration_series(section: DataFrame) -> DataFrame:
    """Chart data: ECE bars with quality."""
    return section.select("Model", "ECE", "Quality")


def reliability_series(section: DataFrame) -> DataFrame:
    """Chart data: radar shares of 25 and the gauge total with its grade."""
    parts = ("Performance", "Calibration", "Robustness", "Confidence")
    return section.select(
        "Model", "Total", "Grade", *[(F.col(c) / F.lit(25.0)).alias(c) for c in parts]
    ).unpivot(["Model", "Total", "Grade"], list(parts), "component", "share")


def stamped(summary_row: DataFrame, dataset: str) -> DataFrame:
    """Summary with the time of the report and the data set it is about."""
    return summary_row.select(
        F.date_format(F.current_timestamp(), STAMP).alias("generated_at"), F.lit(dataset).alias("dataset_name"), "*"
    )


def as_document(summary_row: DataFrame, sections: Mapping[str, DataFrame]) -> DataFrame:
    """The whole report as one nested JSON value.

    Sections hold one row per model (and test), so gathering them is bounded by the model list.
    """
    document = summary_row.select(F.struct("*").alias("summary"))
    for name, section in sections.items():
        rows = section.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name))
        document = document.unionByName(rows, allowMissingColumns=True)
    whole = document.agg(*[F.first(c, ignorenulls=True).alias(c) for c in document.columns])
    return whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("report"))

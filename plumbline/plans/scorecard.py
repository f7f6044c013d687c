"""From predictions and stress results to evidence, scores and a report.

All evidence is read from one small table of cells: predictions are scanned once, counted by
(model, split, true label, predicted label, confidence bin), and never touched again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, binning
from ..operators import evaluate, reliability, report
from ..session import held

HCE_THRESHOLD = 0.9
N_BINS = 10


def evidence_cells(
    pred: DataFrame, n_classes: int | None = None, threshold: float = HCE_THRESHOLD, n_bins: int = N_BINS
) -> DataFrame:
    rows = pred.select(
        "model",
        "model_seq",
        "split",
        "y_true",
        "y_pred",
        arrays.confidence(F.col("proba")).alias("confidence"),
        arrays.entropy(F.col("proba"), n_classes).alias("entropy"),
    )
    wrong = (F.col("y_true") != F.col("y_pred")) & (F.col("confidence") >= F.lit(threshold))
    return (
        rows.withColumn("bin", binning.bin_index(F.col("confidence"), n_bins))
        .groupBy("model", "model_seq", "split", "y_true", "y_pred", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("confidence").alias("conf_sum"),
            F.sum("entropy").alias("entropy_sum"),
            F.count(F.when(wrong, F.lit(1))).alias("hce"),
        )
    )


def metrics(cells: DataFrame) -> DataFrame:
    """model_metrics(model, model_seq, split, accuracy, precision, recall, f1) from the cells."""
    keys = ("model", "model_seq", "split")
    counts = cells.groupBy(*keys, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    return evaluate.metrics_from_confusion(counts, keys)


def certainty(cells: DataFrame, split: str = "test") -> DataFrame:
    """(model, ece, avg_entropy, hce_rate, n_classes) of the evidence split."""
    bins = (
        cells.filter(F.col("split") == split)
        .groupBy("model", "bin")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))).alias("hits"),
            F.sum("conf_sum").alias("conf_sum"),
            F.sum("entropy_sum").alias("entropy_sum"),
            F.sum("hce").alias("hce"),
        )
    )
    total = F.sum("n")
    measures = bins.groupBy("model").agg(
        (F.sum(F.abs(F.col("hits") - F.col("conf_sum"))) / total).alias("ece"),
        (F.sum("entropy_sum") / total).alias("avg_entropy"),
        (F.sum("hce") / total).alias("hce_rate"),
    )
    classes = (
        cells.filter(F.col("split") == split)
        .groupBy("model")
        .agg(F.count_distinct("y_true").cast("int").alias("n_classes"))
    )
    return measures.join(classes, "model")


def mean_drop(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.avg("performance_drop").alias("avg_drop"))


def evidence(
    models: DataFrame,
    cells: DataFrame,
    results: DataFrame | None = None,
    split: str = "test",
    evidence_split: str = "test",
) -> DataFrame:
    """model_evidence for every trained model; an absent measure is null.

    Metrics are those of ``split``; calibration and certainty are those of ``evidence_split``.
    """
    table = (
        models.select("model", "model_seq")
        .join(metrics(cells).filter(F.col("split") == split).select("model", "accuracy", "f1"), "model", "left")
        .join(certainty(cells, evidence_split), "model", "left")
    )
    if results is None:
        return table.withColumn("avg_drop", F.lit(None).cast("double"))
    return table.join(mean_drop(results), "model", "left")


def scorecard(
    models: DataFrame,
    pred: DataFrame,
    results: DataFrame | None = None,
    split: str = "test",
    evidence_split: str = "test",
    n_classes: int | None = None,
) -> DataFrame:
    """Reliability scores straight from predictions; the cells are written once and read thrice."""
    cells = held(evidence_cells(pred, n_classes))
    return reliability.score(evidence(models, cells, results, split, evidence_split))


def sections(
    models: DataFrame, cells: DataFrame, results: DataFrame, scores: DataFrame, split: str = "test"
) -> dict[str, DataFrame]:
    """The four report sections."""
    return {
        "performance": report.performance(models, metrics(cells), split),
        "robustness": report.robustness(models, results),
        "calibration": report.calibration(models, certainty(cells)),
        "reliability": report.reliability(models, scores),
    }


def compile_report(models: DataFrame, pred: DataFrame, results: DataFrame, split: str = "test", n_classes=None) -> dict:
    """Sections, stamped summary and the scores they rest on."""
    cells = held(evidence_cells(pred, n_classes))
    kept = held(results)
    scores = held(reliability.score(evidence(models, cells, kept, split)))
    parts = sections(models, cells, kept, scores, split)
    return {
        "sections": parts,
        "scores": scores,
        "summary": report.stamped(report.summary(models, parts), split.capitalize()),
    }

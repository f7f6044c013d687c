"""Unified 0-100 reliability score from four components of 25 points each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, text
from ..functions.rounding import nearest

# Points per component, and the value that costs all of them.
POINTS = 25.0
NEUTRAL = POINTS / 2
WORST_ECE = 0.5
WORST_DROP = 0.5
COMPONENTS = ("Performance", "Calibration", "Robustness", "Confidence")

# Per component, advice below the first limit and below the second.
ADVICE = {
    "performance": (
        (15.0, "🔴 **Performance** is low. Consider adding more training data, feature engineering, "
               "or trying a more powerful model architecture."),
        (20.0, "🟡 **Performance** is moderate. "
               "Hyperparameter tuning or ensemble methods may improve accuracy/F1."),
    ),
    "calibration": (
        (12.0, "🔴 **Calibration** is poor (high ECE). "
               "Apply temperature scaling (Module 6) or use Platt scaling / isotonic regression."),
        (18.0, "🟡 **Calibration** could be improved. "
               "Review the confidence histogram and consider post-hoc calibration."),
    ),
    "robustness": (
        (12.0, "🔴 **Robustness** is low. Model is sensitive to perturbations. "
               "Consider data augmentation, adversarial training, or feature standardisation."),
        (18.0, "🟡 **Robustness** is moderate. "
               "Investigate which stress types cause the largest drops (Module 4)."),
    ),
    "confidence": (
        (12.0, "🔴 **Confidence Quality** is poor. "
               "The model produces high-entropy or misleadingly confident predictions. "
               "Review high-confidence errors (Module 3)."),
        (18.0, "🟡 **Confidence Quality** is moderate. "
               "Some high-confidence errors detected — inspect borderline cases."),
    ),
}
ALL_GOOD = "✅ All reliability components are in good shape. Continue monitoring with new data distributions."
NOTHING_MISSING = "—"

# Raw inputs and their headings.
INPUTS = {
    "accuracy": "Accuracy",
    "f1": "F1 Score",
    "ece": "ECE",
    "avg_drop": "Avg Drop",
    "avg_entropy": "Avg Entropy",
    "hce_rate": "HCE Rate",
}


def performance_points(accuracy: Column, f1: Column) -> Column:
    return F.round((accuracy + f1) / F.lit(2.0) * F.lit(POINTS), 3)


def calibration_points(ece: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - ece / F.lit(WORST_ECE)) * F.lit(POINTS), 3)


def robustness_points(drop: Column) -> Column:
    """No upper limit: accuracy that improves under stress scores above 25."""
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - drop / F.lit(WORST_DROP)) * F.lit(POINTS), 3)


def confidence_points(entropy: Column, hce_rate: Column, max_entropy: Column) -> Column:
    share = F.when(max_entropy > 0, F.least(entropy / max_entropy, F.lit(1.0))).otherwise(F.lit(0.0))
    half = F.lit(POINTS / 2)
    return F.round((F.lit(1.0) - share) * half + F.greatest(F.lit(0.0), F.lit(1.0) - hce_rate) * half, 3)


def score(evidence: DataFrame, entropy_base: float = 2.0) -> DataFrame:
    """Component points, total, grade, available and missing components, raw inputs.

    A component without evidence counts half its points. The entropy evidence is in nats while the
    default maximum is in bits; pass ``entropy_base=math.e`` for equal units.
    """
    has = {
        "Performance": F.col("accuracy").isNotNull() & F.col("f1").isNotNull(),
        "Calibration": F.col("ece").isNotNull(),
        "Robustness": F.col("avg_drop").isNotNull(),
        "Confidence": F.col("avg_entropy").isNotNull() & F.col("hce_rate").isNotNull(),
    }
    top = F.ln(F.greatest(F.coalesce(F.col("n_classes"), F.lit(2)), F.lit(2)).cast("double")) / F.ln(F.lit(entropy_base))
    points = {
        "Performance": performance_points(F.col("accuracy"), F.col("f1")),
        "Calibration": calibration_points(F.col("ece")),
        "Robustness": robustness_points(F.col("avg_drop")),
        "Confidence": confidence_points(F.col("avg_entropy"), F.col("hce_rate"), top),
    }

    def names(keep) -> Column:
        return F.array_compact(F.array(*[F.when(keep(has[c]), F.lit(c)) for c in COMPONENTS]))

    scored = evidence.select(
        "model",
        "model_seq",
        *[F.when(has[c], points[c]).otherwise(F.lit(NEUTRAL)).alias(c.lower()) for c in COMPONENTS],
        names(lambda c: c).alias("available_components"),
        names(lambda c: ~c).alias("missing_components"),
        F.struct(*INPUTS).alias("details"),
    )
    points_sum = sum((F.col(c.lower()) for c in COMPONENTS[1:]), F.col("performance"))
    graded = (
        scored.withColumn("total", points_sum)
        .withColumn("total", F.expr(nearest("total", 2)))
        .withColumn("grade", bands.grade(F.col("total")))
    )
    return graded.withColumn("colour", bands.grade_colour(F.col("grade")))


def summary(scores: DataFrame) -> DataFrame:
    """Formatted score table, best total first."""
    missing = F.when(F.size("missing_components") > 0, F.array_join("missing_components", ", ")).otherwise(
        F.lit(NOTHING_MISSING)
    )
    return scores.orderBy(F.desc("total"), "model_seq").select(
        "model",
        text.fixed(F.col("total"), 1).alias("total"),
        "grade",
        *[text.fixed(F.col(c.lower()), 1, " / 25").alias(c.lower()) for c in COMPONENTS],
        missing.alias("missing_data"),
    )


def recommendations(scores: DataFrame) -> DataFrame:
    """Ordered advice lines (model, line, text) per model."""
    lines = []
    for component, steps in ADVICE.items():
        lines.append(bands.below(F.col(component), list(steps), ""))
    found = F.filter(F.array(*lines), lambda t: t != F.lit(""))
    shown = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ALL_GOOD)))
    return scores.select("model", F.posexplode(shown).alias("line", "text"))


def missing_components(scores: DataFrame) -> DataFrame:
    """Sorted distinct components that some model lacks."""
    return scores.select(F.explode("missing_components").alias("component")).distinct().orderBy("component")


def best(scores: DataFrame) -> DataFrame:
    """Highest total, the first trained model on ties."""
    return scores.orderBy(F.desc("total"), "model_seq").limit(1).select("model", "total", "grade")


def raw_inputs(scores: DataFrame) -> DataFrame:
    """(model, metric, value) with 'N/A' for an unknown input."""
    rows = F.array(
        *[
            F.struct(
                F.lit(heading).alias("metric"),
                F.coalesce(text.fixed(F.col(f"details.{name}"), 4), F.lit("N/A")).alias("value"),
            )
            for name, heading in INPUTS.items()
        ]
    )
    return scores.select("model", F.inline(rows))


def radar(scores: DataFrame) -> DataFrame:
    """Chart data: component points as a share of 25."""
    return scores.select(
        "model", *[(F.col(c.lower()) / F.lit(POINTS)).alias(c) for c in COMPONENTS]
    ).unpivot(["model"], list(COMPONENTS), "component", "share")


def stacked(scores: DataFrame) -> DataFrame:
    """Chart data: component points."""
    return scores.select("model", *[F.col(c.lower()).alias(c) for c in COMPONENTS]).unpivot(
        ["model"], list(COMPONENTS), "component", "points"
    )


def total_series(scores: DataFrame) -> DataFrame:
    """Chart data: totals with grade and colour, best first."""
    return scores.orderBy(F.desc("total"), "model_seq").select("model", "total", "grade", "colour")

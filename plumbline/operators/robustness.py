"""Analysis of stress results: robustness score, vulnerabilities, categories, recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bands, text

# Score weights.
WEIGHTS = {"accuracy_retention": 0.4, "prediction_stability": 0.3, "performance_consistency": 0.3}

# Stress categories and the words that put a test into them.
CATEGORIES = {
    "Noise": ("gaussian", "uniform"),
    "Dropout": ("dropout",),
    "Corruption": ("corruption",),
    "Scaling": ("scale",),
    "Distribution": ("shift", "distribution"),
}

# Recommendation texts.
NO_RESULTS = "No stress test results available for analysis."
BAND_LINES = {
    "Excellent": ("✅ **Excellent robustness** (score: ", "/100). Model performs well under stress."),
    "Good": ("⚠️ **Good robustness** (score: ", "/100). Some improvements possible."),
    "Moderate": ("⚠️ **Moderate robustness** (score: ", "/100). Consider improvements."),
    "Low": ("❌ **Low robustness** (score: ", "/100). Significant improvements needed."),
}
KEY_HEADER = "\n**Key Vulnerabilities:**"
ACTION_HEADER = "\n**Recommended Actions:**"
ACTIONS = {
    "noise": ("- **Add noise augmentation** to training data to improve noise robustness",),
    "dropout": (
        "- **Feature engineering**: Some features may be too critical. Add redundant features.",
        "- Consider **dropout regularization** during training",
    ),
    "corruption": (
        "- **Outlier handling**: Improve robustness to corrupted values",
        "- Add **data validation** in production pipeline",
    ),
    "scale": (
        "- **Feature scaling**: Ensure consistent scaling in production",
        "- Consider **scale-invariant features**",
    ),
}
STABILITY_LINE = ("\n- **Low prediction stability** (", " agreement). Model predictions are inconsistent under stress.")
STABILITY_ADVICE = (
    "  - Consider ensemble methods for more stable predictions",
    "  - Increase model capacity or regularization",
)
STABLE_FROM = 0.8
NOTABLE_DROP = 20.0
WORST_SHOWN = 3


def upsert(old: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Keyed upsert on (model, test_name): the new row wins, other rows stay.

    ``replace`` drops every old row of a model that has new ones.
    """
    on = ["model"] if replace else ["model", "test_name"]
    kept = old.join(new.select(*on).distinct(), on, "left_anti")
    return kept.unionByName(new)


def _dimensions() -> list[Column]:
    """The aggregates over a model's tests that its score is made of."""
    before, after = F.col("accuracy_original"), F.col("accuracy_stressed")
    kept = F.when(before > 0, F.least(after / before, F.lit(1.0)))
    mean = F.avg(after)
    spread = F.when(mean != 0, F.lit(1.0) - F.stddev_pop(after) / mean).otherwise(F.lit(0.0))
    steady = F.when(
        F.count(F.lit(1)) > 1, F.greatest(F.lit(0.0), F.least(spread, F.lit(1.0)))
    ).otherwise(F.lit(1.0))
    return [
        F.coalesce(F.avg(kept), F.lit(0.0)).alias("retention"),
        F.avg("prediction_agreement").alias("stability"),
        steady.alias("consistency"),
    ]


def _overall(weights: Mapping[str, float] | None = None) -> Column:
    w = dict(weights or WEIGHTS)
    total = (
        F.lit(w["accuracy_retention"]) * F.col("retention")
        + F.lit(w["prediction_stability"]) * F.col("stability")
        + F.lit(w["performance_consistency"]) * F.col("consistency")
    )
    return (total * F.lit(100.0)).alias("overall_score")


def scores(results: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """overall_score and its three dimensions (0-100) per model."""
    hundred = F.lit(100.0)
    return results.groupBy("model", "model_seq").agg(*_dimensions()).select(
        "model",
        "model_seq",
        _overall(weights),
        (F.col("retention") * hundred).alias("accuracy_retention"),
        (F.col("stability") * hundred).alias("prediction_stability"),
        (F.col("consistency") * hundred).alias("performance_consistency"),
    )


def scores_for(models: DataFrame, results: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Score of every listed model; 0 when it was never stressed."""
    return models.select("model", "model_seq").join(
        scores(results, weights).drop("model_seq"), "model", "left"
    ).fillna(0.0, ["overall_score"])


def vulnerability(results: DataFrame) -> DataFrame:
    """Drop, accuracy loss, changed predictions and severity per test, worst first."""
    return results.select(
        "model",
        "test_seq",
        "test_name",
        F.col("performance_drop_pct").alias("drop_pct"),
        F.col("performance_drop").alias("accuracy_loss"),
        ((F.lit(1.0) - F.col("prediction_agreement")) * F.lit(100.0)).alias("changed_pct"),
        "accuracy_stressed",
        "f1_stressed",
        bands.severity(F.col("performance_drop_pct")).alias("severity"),
    ).orderBy("model", F.desc("drop_pct"), "test_seq")


def categories_of(name: Column) -> Column:
    """Every category whose words occur in the lower-cased test name."""
    lowered = F.lower(name)
    matches = []
    for category, words in CATEGORIES.items():
        found = lowered.contains(words[0])
        for word in words[1:]:
            found = found | lowered.contains(word)
        matches.append(F.when(found, F.lit(category)))
    return F.array_compact(F.array(*matches))


def category_summary(results: DataFrame) -> DataFrame:
    """Tests, mean and maximum drop, mean agreement and robustness per model and category."""
    placed = results.select(
        "model",
        F.explode(categories_of(F.col("test_name"))).alias("category"),
        "performance_drop_pct",
        "prediction_agreement",
    )
    return (
        placed.groupBy("model", "category")
        .agg(
            F.count(F.lit(1)).alias("num_tests"),
            F.avg("performance_drop_pct").alias("avg_drop_pct"),
            F.max("performance_drop_pct").alias("max_drop_pct"),
            F.avg("prediction_agreement").alias("avg_agreement"),
        )
        .withColumn("robustness", bands.category_robustness(F.col("avg_drop_pct")))
    )


def comparison(results: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Score table of the chosen (default: all) stressed models."""
    table = scores(results)
    if models is not None:
        table = table.filter(F.col("model").isin(*models))
    return table


def kpis(results: DataFrame) -> DataFrame:
    """Worst test (20 characters), its drop, Critical and High counts and the mean drop per model."""
    drop = F.col("performance_drop_pct")
    severity = bands.severity(drop)
    worst = F.max_by("test_name", F.struct(drop, (-F.col("test_seq")).alias("s")))
    named = results.groupBy("model").agg(
        worst.alias("worst"),
        F.max(drop).alias("worst_drop_pct"),
        F.count(F.when(severity == "Critical", F.lit(1))).alias("critical"),
        F.count(F.when(severity == "High", F.lit(1))).alias("high"),
        F.avg(drop).alias("avg_drop_pct"),
    )
    short = F.when(F.length("worst") > 20, F.concat(F.substring("worst", 1, 20), F.lit("..."))).otherwise(F.col("worst"))
    return named.select(
        "model",
        short.alias("worst_test"),
        "worst_drop_pct",
        (F.col("critical") + F.col("high")).alias("high_risk"),
        "critical",
        "high",
        "avg_drop_pct",
    )


def interpretation(score_table: DataFrame) -> DataFrame:
    return score_table.withColumn("band", bands.score_band(F.col("overall_score")))


def most_robust(score_table: DataFrame) -> DataFrame:
    """Best score at one decimal, the first trained model on ties."""
    shown = F.round("overall_score", 1)
    return (
        score_table.orderBy(F.desc(shown), "model_seq").limit(1).select("model", shown.alias("overall_score"))
    )


def recommendations(results: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Ordered lines (model, line, text); listed models without results get the no-data line.

    ``results`` is read once: the worst tests are ranked in the partitioning by model that the one aggregate uses too.
    """
    drop = F.col("performance_drop_pct")
    severe = bands.severity(drop).isin("High", "Critical")
    lowered = F.lower("test_name")
    order = Window.partitionBy("model").orderBy(F.desc("performance_drop_pct"), "test_seq")
    worst_line = F.concat(
        F.lit("- **"), F.col("test_name"), F.lit("**: "), text.fixed(drop, 1), F.lit("% drop ("), bands.severity(drop), F.lit(" severity)")
    )
    summary = (
        results.withColumn("rank", F.row_number().over(order))
        .groupBy("model", "model_seq")
        .agg(
            *_dimensions(),
            F.max(severe).alias("any"),
            *[F.max(severe & lowered.contains(word)).alias(word) for word in ACTIONS],
            F.avg("prediction_agreement").alias("agreement"),
            *[
                F.max(F.when((F.col("rank") == r) & (drop > F.lit(NOTABLE_DROP)), worst_line)).alias(f"worst_{r}")
                for r in range(1, WORST_SHOWN + 1)
            ],
        )
        .select("*", _overall())
    )
    if models is None:
        listed = summary
    else:
        listed = models.select("model").distinct().join(summary, "model", "full")
    score = F.col("overall_score")
    shown = text.fixed(score, 1)
    band = bands.score_band(score)
    band_line = F.when(score.isNull(), F.lit(NO_RESULTS))
    for name, (head, tail) in BAND_LINES.items():
        band_line = band_line.when(band == name, F.concat(F.lit(head), shown, F.lit(tail)))
    shaky = F.col("agreement") < F.lit(STABLE_FROM)
    lines: list[tuple[int, Column]] = [
        (0, band_line),
        (1, F.when(score.isNotNull(), F.lit(KEY_HEADER))),
        *[(9 + r, F.col(f"worst_{r}")) for r in range(1, WORST_SHOWN + 1)],
        (20, F.when(F.col("any"), F.lit(ACTION_HEADER))),
    ]
    at = 30
    for word, texts in ACTIONS.items():
        for advice in texts:
            lines.append((at, F.when(F.col(word), F.lit(advice))))
            at += 1
    lines.append(
        (
            40,
            F.when(
                shaky,
                F.concat(F.lit(STABILITY_LINE[0]), text.percent(F.col("agreement"), 1), F.lit(STABILITY_LINE[1])),
            ),
        )
    )
    lines += [(41 + i, F.when(shaky, F.lit(advice))) for i, advice in enumerate(STABILITY_ADVICE)]
    placed = F.inline(F.array(*[F.struct(F.lit(n).alias("line"), c.alias("text")) for n, c in lines]))
    return listed.select("model", placed).filter(F.col("text").isNotNull())


def radar(score_table: DataFrame) -> DataFrame:
    """Chart data: the three dimensions per model."""
    return score_table.select(
        "model",
        F.col("accuracy_retention").alias("Accuracy Retention"),
        F.col("prediction_stability").alias("Prediction Stability"),
        F.col("performance_consistency").alias("Performance Consistency"),
    ).unpivot(
        ["model"], ["Accuracy Retention", "Prediction Stability", "Performance Consistency"], "dimension", "value"
    )


def heatmap(table: DataFrame) -> DataFrame:
    """Chart data: drop and changed predictions per test, rounded to 2 digits."""
    return table.select(
        "model", "test_name", F.round("drop_pct", 2).alias("drop"), F.round("changed_pct", 2).alias("changed")
    ).unpivot(["model", "test_name"], ["drop", "changed"], "metric", "value")

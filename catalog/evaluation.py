"""Classification metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evaluate

from . import fixtures as fx
from .base import big, fixed, query, r6, tidy

KEYS = ["model", "split"]
SEQ_KEYS = ["model", "model_seq", "split"]
CM = f"{fx.SQL_PREDICTIONS}, {fx.confusion_metrics_sql('pred', 'model, model_seq, split')}"


def metric_table(spark, sf):
    return evaluate.metrics(fx.predictions(spark, sf), SEQ_KEYS)


def _metric(name: str, column: str):
    @query(name, f"WITH {CM} SELECT model, split, {r6(column)} AS {column} FROM cm_metrics")
    def run(spark, sf):
        return tidy(metric_table(spark, sf).select(*KEYS, column))

    return run


_metric("m5_accuracy", "accuracy")
_metric("m6_weighted_precision", "precision")
_metric("m7_weighted_recall", "recall")
_metric("m8_weighted_f1", "f1")

MATRIX = f"""{CM}, cm_grid AS (SELECT a.model, a.split, a.label AS y_true, b.label AS y_pred FROM cm_labels a
  JOIN cm_labels b ON a.model = b.model AND a.split = b.split),
cm_matrix AS (SELECT g.model, g.split, g.y_true, g.y_pred, coalesce(c.n, 0) AS n FROM cm_grid g LEFT JOIN cm_counts c
  ON c.model = g.model AND c.split = g.split AND c.y_true = g.y_true AND c.y_hat = g.y_pred)"""


@query(
    "m9_confusion_matrix",
    f"WITH {MATRIX} SELECT model, split, {big('y_true')} AS y_true, {big('y_pred')} AS y_pred, {big('n')} AS n FROM cm_matrix",
)
def m9(spark, sf):
    return tidy(evaluate.confusion_matrix(fx.predictions(spark, sf), KEYS))


@query(
    "m9_confusion_counts",
    fx.with_predictions(f"SELECT model, split, {big('y_true')} AS y_true, {big('y_pred')} AS y_pred, {big('count(*)')} AS n FROM pred GROUP BY ALL"),
)
def m9_counts(spark, sf):
    """The sparse form: only pairs that occur."""
    return tidy(evaluate.confusion_counts(fx.predictions(spark, sf), KEYS).select(*KEYS, "y_true", "y_pred", "n"))


@query(
    "m9_confusion_wide",
    f"WITH {MATRIX} SELECT model, split, {big('y_true')} AS y_true, "
    + ", ".join(f"{big(f'sum(CASE WHEN y_pred = {c} THEN n ELSE 0 END)')} AS pred_{c}" for c in range(fx.K))
    + " FROM cm_matrix GROUP BY model, split, y_true",
)
def m9_wide(spark, sf):
    return tidy(evaluate.confusion_wide(fx.predictions(spark, sf), range(fx.K), KEYS))


@query(
    "m10_metrics_by_split",
    f"WITH {CM} SELECT model, split, " + ", ".join(f"{r6(c)} AS {c}" for c in evaluate.METRICS) + " FROM cm_metrics",
)
def m10(spark, sf):
    return tidy(metric_table(spark, sf).select(*KEYS, *evaluate.METRICS))


_PRF = ("precision", "recall", "f1")


@query(
    "m11_classification_report",
    f"""WITH {CM}
    SELECT model, split, label::VARCHAR AS label, {', '.join(f'{r6(c)} AS {c}' for c in _PRF)}, {r6('support')} AS support FROM cm_classes
    UNION ALL SELECT model, split, 'accuracy', {', '.join(f'{r6("accuracy")}' for _ in range(4))} FROM cm_metrics
    UNION ALL SELECT model, split, 'macro avg', {', '.join(r6(f'avg({c})') for c in _PRF)}, {r6('sum(support)')} FROM cm_classes GROUP BY model, split
    UNION ALL SELECT model, split, 'weighted avg', {', '.join(r6(f'sum(support * {c}) / sum(support)') for c in _PRF)}, {r6('sum(support)')}
    FROM cm_classes GROUP BY model, split""",
)
def m11(spark, sf):
    return tidy(evaluate.report(fx.predictions(spark, sf), KEYS))


@query(
    "m14_best_model",
    f"WITH {CM} SELECT model, {r6('f1')} AS score FROM cm_metrics WHERE split = 'test' ORDER BY f1 DESC, model_seq LIMIT 1",
)
def m14(spark, sf):
    return tidy(evaluate.best(metric_table(spark, sf), "f1", "test"))


@query(
    "m15_model_summary",
    f"""WITH {CM} SELECT model, upper(substr(split, 1, 1)) || substr(split, 2) AS dataset,
    {', '.join(f'{fixed(c, 4)} AS {c}' for c in evaluate.METRICS)} FROM cm_metrics""",
)
def m15(spark, sf):
    return evaluate.summary(metric_table(spark, sf))


@query(
    "m16_metric_series",
    f"WITH {CM} "
    + " UNION ALL ".join(
        f"SELECT model, '{c}' AS metric, {r6(c)} AS value FROM cm_metrics WHERE split = 'validation'"
        for c in evaluate.METRICS
    ),
)
def m16(spark, sf):
    return tidy(evaluate.metric_series(metric_table(spark, sf), "validation"))


@query(
    "m17_probabilities",
    fx.with_predictions(
        f"SELECT row_id, {', '.join(f'{r6(f"p{c}")} AS p_{c}' for c in range(fx.K))} FROM pred WHERE model = 'fix_b' AND split = 'test'"
    ),
)
def m17(spark, sf):
    stored = evaluate.probabilities(fx.predictions(spark, sf), "fix_b", "test")
    return tidy(stored.select("row_id", *[F.get("proba", F.lit(c)).alias(f"p_{c}") for c in range(fx.K)]))

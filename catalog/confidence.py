"""Confidence and uncertainty queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.functions import binning
from plumbline.operators import confidence

from . import fixtures as fx
from .base import bin_sql, big, num, query, r6, tidy

KEYS = ["model", "split"]
THR = 0.8
EDGES = binning.edges(10)
EDGES20 = binning.edges(20)
WRONG = f"(y_true <> y_pred AND confidence >= {num(THR)})"


def preds(spark, sf):
    return fx.predictions(spark, sf)


@query(
    "q1_confidence",
    fx.with_predictions(f"SELECT model, row_id, {r6('confidence')} AS confidence FROM pred"),
)
def q1(spark, sf):
    return tidy(confidence.confidence_frame(preds(spark, sf)).select("model", "row_id", "confidence"))


@query(
    "q2_entropy",
    fx.with_predictions(f"SELECT model, row_id, {r6(fx.ENTROPY_SQL)} AS entropy FROM pred"),
)
def q2(spark, sf):
    return tidy(confidence.with_confidence(preds(spark, sf), fx.K).select("model", "row_id", "entropy"))


@query(
    "q3_confidence_bins",
    fx.with_predictions(f"SELECT model, row_id, {big(bin_sql('confidence', EDGES))} AS bin FROM pred"),
)
def q3(spark, sf):
    return tidy(confidence.binned(preds(spark, sf)).select("model", "row_id", "bin"))


@query(
    "q4_high_confidence_errors",
    fx.with_predictions(
        f"""SELECT model, split, {big(f'count(*) FILTER (WHERE {WRONG})')} AS error_count,
        {r6(f'count(*) FILTER (WHERE {WRONG}) * 100e0 / count(*)')} AS error_pct,
        {r6(f'coalesce(avg(confidence) FILTER (WHERE {WRONG}), 0e0)')} AS avg_confidence FROM pred GROUP BY ALL"""
    ),
)
def q4(spark, sf):
    return tidy(confidence.high_confidence_error_summary(preds(spark, sf), THR))


@query(
    "q4_high_confidence_error_rows",
    fx.with_predictions(
        f"""SELECT model, split, row_id, {big('y_true')} AS true_label, {big('y_pred')} AS predicted_label,
        {r6('confidence')} AS confidence, y_true = y_pred AS correct FROM pred WHERE {WRONG}"""
    ),
)
def q4_rows(spark, sf):
    return tidy(confidence.high_confidence_errors(preds(spark, sf), THR))


@query(
    "q5_brier_score",
    fx.with_predictions(f"SELECT model, split, {r6('avg(' + fx.brier_sql() + ')')} AS brier FROM pred GROUP BY ALL"),
)
def q5(spark, sf):
    return tidy(confidence.brier(preds(spark, sf), KEYS, fx.K))


@query(
    "q6_confidence_frame",
    fx.with_predictions(
        f"""SELECT model, split, row_id, {big('y_true')} AS true_label, {big('y_pred')} AS predicted_label,
        {r6('confidence')} AS confidence, y_true = y_pred AS correct FROM pred"""
    ),
)
def q6(spark, sf):
    return tidy(confidence.confidence_frame(preds(spark, sf)))


@query(
    "q7_overview",
    fx.with_predictions(
        f"""SELECT model, split, {r6('avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END)')} AS accuracy,
        {r6('avg(confidence)')} AS avg_confidence,
        {r6('avg(confidence) FILTER (WHERE y_true = y_pred)')} AS avg_confidence_correct FROM pred GROUP BY ALL"""
    ),
)
def q7(spark, sf):
    return tidy(confidence.overview(preds(spark, sf)))


@query(
    "q8_threshold_split",
    fx.with_predictions(
        f"""SELECT model, split, CASE WHEN confidence >= {num(THR)} THEN 'high' ELSE 'low' END AS level, {big('count(*)')} AS n,
        {r6('avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM pred GROUP BY ALL"""
    ),
)
def q8(spark, sf):
    return tidy(confidence.threshold_split(preds(spark, sf), THR))


@query(
    "q9_errors_by_class",
    fx.with_predictions(
        f"SELECT model, split, {big('y_true')} AS true_label, {big('count(*)')} AS n FROM pred WHERE {WRONG} GROUP BY ALL"
    ),
)
def q9(spark, sf):
    return tidy(confidence.errors_by_class(preds(spark, sf), THR))


@query(
    "q10_entropy_stats",
    fx.with_predictions(
        f"""SELECT model, split, {r6('avg(h)')} AS mean_entropy, {r6('max(h)')} AS max_entropy, {r6('min(h)')} AS min_entropy,
        {r6('stddev_pop(h)')} AS std_entropy FROM (SELECT model, split, {fx.ENTROPY_SQL} AS h FROM pred) GROUP BY ALL"""
    ),
)
def q10(spark, sf):
    return tidy(confidence.entropy_stats(preds(spark, sf), KEYS, fx.K))


@query(
    "q11_most_uncertain",
    fx.with_predictions(
        f"""SELECT row_id, {big('y_true')} AS true_label, {big('y_pred')} AS predicted_label, {r6('confidence')} AS confidence,
        {r6('h')} AS entropy, y_true = y_pred AS correct FROM (SELECT *, {fx.ENTROPY_SQL} AS h FROM pred
        WHERE model = 'fix_a' AND split = 'test') ORDER BY h DESC, row_id LIMIT 10"""
    ),
)
def q11(spark, sf):
    return tidy(confidence.most_uncertain(preds(spark, sf), "fix_a", "test", 10, fx.K))


@query(
    "q12_confidence_histogram",
    fx.with_predictions(
        f"""SELECT model, split, y_true = y_pred AS correct, {big(bin_sql('confidence', EDGES20))} AS bin, {big('count(*)')} AS n
        FROM pred GROUP BY ALL"""
    ),
)
def q12(spark, sf):
    return tidy(confidence.confidence_histogram(preds(spark, sf)))


@query(
    "q13_confidence_by_class",
    fx.with_predictions(
        f"""SELECT model, split, {big('y_pred')} AS y_pred, {big('count(*)')} AS n, {r6('avg(confidence)')} AS mean,
        {r6('stddev_pop(confidence)')} AS std, {r6('min(confidence)')} AS min, {r6('max(confidence)')} AS max,
        {r6('quantile_cont(confidence, 0.25)')} AS q1, {r6('quantile_cont(confidence, 0.5)')} AS median,
        {r6('quantile_cont(confidence, 0.75)')} AS q3 FROM pred GROUP BY model, split, y_pred"""
    ),
)
def q13(spark, sf):
    return tidy(confidence.confidence_by_class(preds(spark, sf)))


CENTRES = [(a + b) / 2 for a, b in zip(EDGES[:-1], EDGES[1:])]


@query(
    "q14_accuracy_curve",
    fx.with_predictions(
        f""", c AS (SELECT model, split, {bin_sql('confidence', EDGES)} AS bin, count(*) AS n,
        sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS hits FROM pred GROUP BY ALL),
        g AS (SELECT * FROM (SELECT DISTINCT model, split FROM pred) CROSS JOIN (VALUES
        {', '.join(f'({i}, {num(c)})' for i, c in enumerate(CENTRES))}) v(bin, centre))
        SELECT g.model, g.split, {big('g.bin')} AS bin, {r6('centre')} AS centre,
        {r6('CASE WHEN n > 0 THEN hits::DOUBLE / n ELSE 0e0 END')} AS accuracy, {big('coalesce(n, 0)')} AS n
        FROM g LEFT JOIN c ON c.model = g.model AND c.split = g.split AND c.bin = g.bin"""
    ),
)
def q14(spark, sf):
    return tidy(confidence.accuracy_curve(preds(spark, sf)))


@query(
    "q15_error_table",
    fx.with_predictions(
        "SELECT model, split, "
        + ", ".join(
            f"{big(f'count(*) FILTER (WHERE {right} AND {level})')} AS {name}"
            for name, right, level in [
                ("high_correct", "y_true = y_pred", f"confidence >= {num(THR)}"),
                ("high_errors", "y_true <> y_pred", f"confidence >= {num(THR)}"),
                ("low_correct", "y_true = y_pred", f"confidence < {num(THR)}"),
                ("low_errors", "y_true <> y_pred", f"confidence < {num(THR)}"),
            ]
        )
        + " FROM pred GROUP BY ALL"
    ),
)
def q15(spark, sf):
    return tidy(confidence.error_table(preds(spark, sf), THR))


SLOT = f"least(greatest(floor((h - 0e0) / {num(math.log(fx.K) / 30)}), 0), 29)"


@query(
    "q16_entropy_histogram",
    fx.with_predictions(
        f"""SELECT model, split, correct, {big(SLOT)} AS bin, {big('count(*)')} AS n
        FROM (SELECT model, split, y_true = y_pred AS correct, {fx.ENTROPY_SQL} AS h FROM pred) GROUP BY ALL"""
    ),
)
def q16(spark, sf):
    return tidy(confidence.entropy_histogram(preds(spark, sf), fx.K))

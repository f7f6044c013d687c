"""Model comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.rounding import nearest
from plumbline.operators import compare
from plumbline.plans import scorecard
from plumbline.session import held

from . import expected
from . import fixtures as fx
from .base import big, fixed, query, r6, text, tidy

NAMES = [s.name for s in fx.SCORERS]
M = compare.METRICS

PERF_CTES = f"""{fx.SQL_PREDICTIONS}, {fx.SQL_TRAINED}, {fx.confusion_metrics_sql('pred', 'model, model_seq, split')},
perf AS (SELECT t.model, t.model_seq, {', '.join(f'round(m.{c}, 4) AS {c}' for c in M)}, m.accuracy IS NOT NULL AS has_data
  FROM trained t LEFT JOIN (SELECT * FROM cm_metrics WHERE split = 'test') m ON m.model = t.model)"""

CERTAINTY_CTES = f"""cert_bins AS (SELECT model, bin, count(*) AS n, sum(hit) AS hits, sum(confidence) AS conf_sum, sum(h) AS entropy_sum, sum(hce) AS hce
  FROM (SELECT model, {{bin}} AS bin, confidence, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS hit, {fx.ENTROPY_SQL} AS h,
        CASE WHEN y_true <> y_pred AND confidence >= 0.9::DOUBLE THEN 1 ELSE 0 END AS hce FROM pred WHERE split = 'test') GROUP BY ALL),
cert AS (SELECT model, sum(abs(hits - conf_sum)) / sum(n) AS ece, sum(entropy_sum) / sum(n) AS avg_entropy,
  sum(hce)::DOUBLE / sum(n) AS hce_rate, 3 AS n_classes FROM cert_bins GROUP BY model)"""


def _certainty() -> str:
    from plumbline.functions import binning

    from .base import bin_sql

    return CERTAINTY_CTES.format(bin=bin_sql("confidence", binning.edges(10)))


CERT = _certainty()
ROBUST = f"""{fx.stress_results_ctes(base=False)},
lin AS (SELECT model, round(greatest(0e0, 100e0 - avg(performance_drop) * 100e0), 2) AS robustness FROM stress_results GROUP BY model)"""
COMPOSITE = f"""{PERF_CTES}, {CERT}, {ROBUST},
raw_comp AS (SELECT p.*, lin.robustness, cert.ece, least((accuracy + f1) / 2e0 * 50e0
  + CASE WHEN lin.robustness IS NULL THEN (accuracy + f1) / 2e0 * 25e0 ELSE lin.robustness / 100e0 * 25e0 END
  + CASE WHEN cert.ece IS NULL THEN (accuracy + f1) / 2e0 * 25e0 ELSE greatest(0e0, 1e0 - cert.ece) * 25e0 END, 100e0) AS points
  FROM perf p LEFT JOIN lin ON lin.model = p.model LEFT JOIN cert ON cert.model = p.model WHERE has_data),
comp AS (SELECT *, {nearest('points', 2)} AS composite FROM raw_comp),
rk AS (SELECT *, row_number() OVER (ORDER BY composite DESC, model_seq) AS rank FROM comp)"""


def cells(spark, sf):
    return held(scorecard.evidence_cells(fx.predictions(spark, sf), fx.K))


def performances(spark, sf, counted=None):
    counted = counted if counted is not None else scorecard.evidence_cells(fx.predictions(spark, sf), fx.K)
    return compare.performance(fx.models(spark), scorecard.metrics(counted))


def composites(spark, sf):
    counted = cells(spark, sf)
    return compare.composite(
        performances(spark, sf, counted),
        compare.linear_robustness(fx.stored_results(spark, sf)),
        scorecard.certainty(counted),
    )


@query(
    "d1_performance_metrics",
    f"WITH {PERF_CTES} SELECT model, {', '.join(f'{r6(c)} AS {c}' for c in M)}, has_data FROM perf",
)
def d1(spark, sf):
    return tidy(performances(spark, sf).drop("model_seq"))


@query(
    "d2_confusion_matrices",
    f"""WITH {PERF_CTES}, g AS (SELECT a.model, a.label AS y_true, b.label AS y_pred FROM cm_labels a JOIN cm_labels b
    ON a.model = b.model AND a.split = b.split WHERE a.split = 'test')
    SELECT g.model, {big('g.y_true')} AS y_true, {big('g.y_pred')} AS y_pred, {big('coalesce(c.n, 0)')} AS n FROM g
    LEFT JOIN (SELECT * FROM cm_counts WHERE split = 'test') c ON c.model = g.model AND c.y_true = g.y_true AND c.y_hat = g.y_pred""",
)
def d2(spark, sf):
    return tidy(compare.confusion_by_model(fx.predictions(spark, sf)))


@query(
    "d3_linear_robustness",
    f"""WITH {fx.stress_results_ctes()} SELECT model, {r6('round(greatest(0e0, 100e0 - avg(performance_drop) * 100e0), 2)')} AS robustness
    FROM stress_results GROUP BY model""",
)
def d3(spark, sf):
    return tidy(compare.linear_robustness(fx.stored_results(spark, sf)))


@query("d4_composite_score", f"WITH {COMPOSITE} SELECT model, {r6('composite')} AS composite FROM comp")
def d4(spark, sf):
    return tidy(composites(spark, sf).select("model", "composite"))


@query(
    "d4_composite_partial",
    f"""WITH {PERF_CTES}, {CERT}, raw_comp AS (SELECT p.model, least((accuracy + f1) / 2e0 * 50e0 + (accuracy + f1) / 2e0 * 25e0
    + greatest(0e0, 1e0 - ece) * 25e0, 100e0) AS points FROM perf p JOIN cert ON cert.model = p.model)
    SELECT model, {r6(nearest('points', 2))} AS composite FROM raw_comp""",
)
def d4_partial(spark, sf):
    """No model was stressed: the robustness points go to performance."""
    counted = cells(spark, sf)
    return tidy(
        compare.composite(performances(spark, sf, counted), None, scorecard.certainty(counted)).select("model", "composite")
    )


REASON = f"""'**' || a.model || '** achieves the highest composite score of **' || {fixed('a.composite', 1)} || '/100**.' || chr(10)
  || '- Accuracy: ' || {fixed('a.accuracy', 3)} || chr(10) || '- F1 Score: ' || {fixed('a.f1', 3)} || chr(10)
  || '- Robustness Score: ' || {fixed('a.robustness', 1)} || '/100' || chr(10) || chr(10) || 'Runner-up: **' || b.model
  || '** (composite score ' || {fixed('b.composite', 1)} || '/100)'"""


@query(
    "d5_recommend_best",
    f"""WITH {COMPOSITE} SELECT a.model AS best_model, {r6('a.composite')} AS composite_score, b.model AS runner_up, {REASON} AS reason
    FROM rk a JOIN rk b ON a.rank = 1 AND b.rank = 2""",
)
def d5(spark, sf):
    return tidy(compare.recommend(composites(spark, sf)))


@query("d6_comparison_table", f"WITH {PERF_CTES} SELECT model, {', '.join(f'{fixed(c, 4)} AS {c}' for c in M)} FROM perf WHERE has_data")
def d6(spark, sf):
    return compare.metric_table(performances(spark, sf))


@query(
    "d7_ranking_table",
    f"""WITH {COMPOSITE} SELECT {big('rank')} AS rank, model, {fixed('composite', 1)} AS composite, {fixed('accuracy', 4)} AS accuracy,
    {fixed('f1', 4)} AS f1, {fixed('robustness', 1)} AS robustness, {fixed('ece', 4)} AS ece FROM rk""",
)
def d7(spark, sf):
    return tidy(compare.ranking_table(composites(spark, sf)))


@query(
    "d8_class_accuracy",
    f"WITH {PERF_CTES} SELECT {big('label')} AS class, "
    + ", ".join(
        f"max(CASE WHEN model = {text(m)} THEN {fixed('hits::DOUBLE / greatest(support, 1)', 3)} END) AS {m}" for m in NAMES
    )
    + " FROM cm_classes WHERE split = 'test' GROUP BY label",
)
def d8(spark, sf):
    return tidy(compare.class_accuracy(fx.predictions(spark, sf), NAMES))


@query(
    "d9_robustness_rating",
    f"""WITH {fx.SQL_FEATURES}, {fx.SQL_MODELS}, {ROBUST} SELECT model, {fixed('robustness', 1, ' / 100')} AS score,
    {expected.rating('robustness')} AS rating FROM lin""",
)
def d9(spark, sf):
    return compare.robustness_rating(compare.linear_robustness(fx.stored_results(spark, sf)))


@query(
    "d10_ece_table",
    f"""WITH {fx.SQL_PREDICTIONS}, {CERT} SELECT model, {fixed('ece', 4)} AS ece,
    {expected.quality('ece')} AS quality FROM cert""",
)
def d10(spark, sf):
    return compare.ece_table(scorecard.certainty(cells(spark, sf)))


@query(
    "d11_metric_series",
    f"WITH {PERF_CTES} " + " UNION ALL ".join(f"SELECT model, '{c}' AS metric, {r6(c)} AS value FROM perf WHERE has_data" for c in M),
)
def d11(spark, sf):
    return tidy(compare.metric_series(performances(spark, sf)))


@query("d11_composite_series", f"WITH {COMPOSITE} SELECT model, {r6('composite')} AS composite FROM comp ORDER BY comp.composite DESC, model_seq")
def d11_composite(spark, sf):
    return tidy(compare.composite_series(composites(spark, sf)))

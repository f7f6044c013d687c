"""Calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import arrays, binning
from plumbline.operators import calibration

from . import expected
from . import fixtures as fx
from .base import bin_sql, big, num, query, r6, tidy

KEYS = ["model", "split"]
EDGES = binning.edges(10)
GLOBAL_T = 1.5


def bins_cte(source: str, keys: str, confidence: str = "confidence", hit: str = "y_pred = y_true", name: str = "kb",
             brier: str | None = None) -> str:
    return f"""{name} AS (SELECT {keys}, {bin_sql(confidence, EDGES)} AS bin, count(*) AS n,
  sum(CASE WHEN {hit} THEN 1 ELSE 0 END) AS hits, sum({confidence}) AS conf_sum, sum({brier or '0e0'}) AS brier_sum
  FROM {source} GROUP BY ALL),
{name}_metrics AS (SELECT {keys}, sum(n) AS n, sum(abs(hits - conf_sum)) / sum(n) AS ece, max(abs(hits - conf_sum) / n) AS mce,
  sum(brier_sum) / sum(n) AS brier, sum(conf_sum) / sum(n) AS avg_confidence, sum(hits)::DOUBLE / sum(n) AS avg_accuracy,
  sum(conf_sum) / sum(n) - sum(hits)::DOUBLE / sum(n) AS overconfidence FROM {name} GROUP BY {keys})"""


BASE = f"{fx.SQL_PREDICTIONS}, {bins_cte('pred', 'model, model_seq, split', brier=fx.brier_sql())}"
QUALITY = expected.quality("ece")


def measures(spark, sf, keys=("model", "model_seq", "split")):
    return calibration.metrics(fx.predictions(spark, sf), keys, n_classes=fx.K)


@query(
    "k1_calibration_metrics",
    f"""WITH {BASE} SELECT model, split, {big('n')} AS n, {', '.join(f'{r6(c)} AS {c}' for c in calibration.MEASURES)}
    FROM kb_metrics""",
)
def k1(spark, sf):
    return tidy(measures(spark, sf).select(*KEYS, "n", *calibration.MEASURES))


BIN_TABLE = f"""kgrid AS (SELECT m.model, m.split, g.bin, g.lo, g.hi FROM (SELECT DISTINCT model, split FROM pred) m
  CROSS JOIN (VALUES {', '.join(f'({i}, {num(EDGES[i])}, {num(EDGES[i + 1])})' for i in range(10))}) g(bin, lo, hi)),
ktable AS (SELECT kgrid.model, kgrid.split, kgrid.bin, lo, hi, coalesce(n, 0) AS n,
  CASE WHEN n > 0 THEN hits::DOUBLE / n ELSE 0e0 END AS acc, CASE WHEN n > 0 THEN conf_sum / n ELSE 0e0 END AS conf
  FROM kgrid LEFT JOIN kb ON kb.model = kgrid.model AND kb.split = kgrid.split AND kb.bin = kgrid.bin)"""


@query(
    "k2_bin_table",
    f"""WITH {BASE}, {BIN_TABLE} SELECT model, split, {big('bin')} AS bin, {r6('lo')} AS lo, {r6('hi')} AS hi,
    {big('n')} AS n, {r6('acc')} AS acc, {r6('conf')} AS conf FROM ktable""",
)
def k2(spark, sf):
    return tidy(calibration.bins(fx.predictions(spark, sf), KEYS, n_classes=fx.K))


@query(
    "k3_brier_out_of_range",
    fx.with_predictions(
        f"""SELECT model, split, {r6('avg(' + fx.brier_sql(y='(y_true + 1)') + ')')} AS brier FROM pred GROUP BY ALL"""
    ),
)
def k3(spark, sf):
    """Labels moved up by one, so the last class lies outside 0..k-1 and one-hots to zero."""
    shifted = fx.predictions(spark, sf).withColumn("y_true", F.col("y_true") + 1)
    return tidy(
        shifted.groupBy(*KEYS).agg(
            F.avg(arrays.squared_error(F.col("proba"), F.col("y_true"), fx.K)).alias("brier")
        )
    )


LONG = " UNION ALL ".join(
    f"SELECT model, split, {c} AS class_index, p{c} AS p, CASE WHEN y_true = {c} THEN 1 ELSE 0 END AS hit FROM pred"
    for c in range(fx.K)
)
PER_CLASS = f"""{fx.SQL_PREDICTIONS}, klong AS ({LONG}),
kcb AS (SELECT model, split, class_index, {bin_sql('p', EDGES)} AS bin, count(*) AS n, sum(hit) AS hits, sum(p) AS p_sum,
  sum((p - hit) * (p - hit)) AS error_sum FROM klong GROUP BY ALL),
kclass AS (SELECT model, split, class_index, round(sum(abs(hits - p_sum)) / sum(n), 4) AS ece,
  round(sum(error_sum) / sum(n), 4) AS brier, round(sum(p_sum) / sum(n), 4) AS avg_probability,
  round(sum(hits)::DOUBLE / sum(n), 4) AS prevalence FROM kcb GROUP BY ALL)"""


@query(
    "k4_per_class",
    f"""WITH {PER_CLASS} SELECT model, split, {big('class_index')} AS class_index, 'Class ' || class_index AS class_name,
    {r6('ece')} AS ece, {r6('brier')} AS brier, {r6('avg_probability')} AS avg_probability, {r6('prevalence')} AS prevalence FROM kclass""",
)
def k4(spark, sf):
    return tidy(calibration.per_class(fx.predictions(spark, sf), KEYS))


def tempered_ctes(temperature: str, source: str = "pred", extra: str = "") -> str:
    """CTEs ending in ``kt``: predictions with q0..q2 = softmax(ln p / T)."""
    clip = [f"ln(least(greatest(p{c}, 1e-10::DOUBLE), 1.0::DOUBLE))" for c in range(fx.K)]
    return f"""kt_l AS (SELECT model, model_seq, split, row_id, y_true, y_pred{extra}, {temperature} AS temperature,
  {', '.join(f'{l} / ({temperature}) AS l{c}' for c, l in enumerate(clip))} FROM {source}),
kt_e AS (SELECT *, {', '.join(f'exp(l{c} - greatest(l0, l1, l2)) AS t{c}' for c in range(fx.K))} FROM kt_l),
kt AS (SELECT *, {', '.join(f't{c} / (t0 + t1 + t2) AS q{c}' for c in range(fx.K))} FROM kt_e)"""


@query(
    "k5_temperature_scaling",
    f"""WITH {fx.SQL_PREDICTIONS}, {tempered_ctes(num(GLOBAL_T))}
    SELECT model, row_id, {r6('q0')} AS q_0, {r6('q1')} AS q_1, {r6('q2')} AS q_2 FROM kt""",
)
def k5(spark, sf):
    scaled = calibration.scale(fx.predictions(spark, sf), GLOBAL_T, fx.K)
    return tidy(scaled.select("model", "row_id", *[F.get("proba", F.lit(c)).alias(f"q_{c}") for c in range(fx.K)]))


GRID = ", ".join(f"({num(t)})" for t in calibration.TEMPERATURES)


@query(
    "k6_optimal_temperature",
    f"""WITH {fx.SQL_PREDICTIONS}, kgrid_t(tt) AS (VALUES {GRID}),
    kx AS (SELECT * FROM pred CROSS JOIN kgrid_t), {tempered_ctes('tt', 'kx')},
    {bins_cte('kt', 'model, split, temperature', confidence='greatest(q0, q1, q2)', name='ks')},
    kr AS (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY ece, temperature) AS rn FROM ks_metrics)
    SELECT model, split, {r6('round(temperature, 2)')} AS temperature, {r6('ece')} AS ece FROM kr WHERE rn = 1""",
)
def k6(spark, sf):
    search = calibration.temperature_search(fx.predictions(spark, sf), KEYS, n_classes=fx.K)
    return tidy(calibration.best_temperature(search, KEYS))


@query("k7_quality", f"WITH {BASE} SELECT model, split, {r6('ece')} AS ece, {QUALITY} AS quality FROM kb_metrics")
def k7(spark, sf):
    return tidy(calibration.with_quality(measures(spark, sf)).select(*KEYS, "ece", "quality"))


@query(
    "k8_reliability_diagram",
    f"""WITH {BASE}, {BIN_TABLE} SELECT model, split, {big('bin')} AS bin, {r6('lo')} AS x0, {r6('hi')} AS x1,
    {r6('conf')} AS conf, {r6('acc')} AS acc, {r6('n / (max(n) OVER (PARTITION BY model, split))::DOUBLE * 20e0 + 6e0')} AS marker_size,
    {r6('least(conf, acc)')} AS y0, {r6('greatest(conf, acc)')} AS y1, conf > acc AS overconfident FROM ktable WHERE n > 0""",
)
def k8(spark, sf):
    return tidy(calibration.diagram(calibration.bins(fx.predictions(spark, sf), KEYS, n_classes=fx.K), KEYS))


@query(
    "k9_metric_table",
    f"""WITH {BASE} SELECT model, split, {', '.join(f'{r6(f"round({c}, 4)")} AS {c}' for c in calibration.MEASURES)},
    {QUALITY} AS quality FROM kb_metrics""",
)
def k9(spark, sf):
    return tidy(calibration.table(measures(spark, sf), KEYS))


@query(
    "k10_best_calibrated",
    f"WITH {BASE} SELECT model, {r6('ece')} AS ece FROM kb_metrics WHERE split = 'test' ORDER BY kb_metrics.ece, model_seq LIMIT 1",
)
def k10(spark, sf):
    return tidy(calibration.best_calibrated(measures(spark, sf)))


@query(
    "k11_worst_class",
    f"""WITH {PER_CLASS}, kw AS (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY ece DESC, class_index) AS rn FROM kclass)
    SELECT model, split, 'Class ' || class_index AS class_name, {r6('ece')} AS ece FROM kw WHERE rn = 1""",
)
def k11(spark, sf):
    return tidy(calibration.worst_class(calibration.per_class(fx.predictions(spark, sf), KEYS), KEYS))


def _before_after_sql() -> str:
    names = ("ece", "mce", "brier")
    return f"""WITH {BASE}, {tempered_ctes(num(GLOBAL_T))},
    {bins_cte('kt', 'model, split', confidence='greatest(q0, q1, q2)', name='ka', brier=fx.brier_sql('q'))}
    SELECT b.model, b.split, {', '.join(f'{r6(f"b.{c}")} AS {c}_before, {r6(f"a.{c}")} AS {c}_after, {r6(f"a.{c} - b.{c}")} AS {c}_delta' for c in names)},
    {expected.quality('b.ece')} AS quality_before,
    {expected.quality('a.ece')} AS quality_after
    FROM kb_metrics b JOIN ka_metrics a ON a.model = b.model AND a.split = b.split"""


@query("k12_before_after", _before_after_sql())
def k12(spark, sf):
    return tidy(calibration.before_after(fx.predictions(spark, sf), GLOBAL_T, KEYS, n_classes=fx.K))


@query(
    "k13_comparison_data",
    f"WITH {BASE} " + " UNION ALL ".join(
        f"SELECT model, split, '{c}' AS measure, {r6(c)} AS value FROM kb_metrics" for c in ("ece", "mce", "brier")
    ),
)
def k13(spark, sf):
    return tidy(calibration.comparison(measures(spark, sf), KEYS))

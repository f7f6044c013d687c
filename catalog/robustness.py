"""Post-stress queries over the full suite and all models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import bands
from plumbline.operators import robustness as rb
from plumbline.session import shared_folder
from plumbline.sources.stored import StoredTable

from . import expected
from . import fixtures as fx
from .base import big, fixed, percent, query, r6, text, tidy

SUITE = f"WITH {fx.stress_results_ctes()}"
SEVERITY = expected.severity("performance_drop_pct")


def results(spark, sf):
    return fx.stored_results(spark, sf)


def score_cte(weights=rb.WEIGHTS, name: str = "rs", source: str = "stress_results") -> str:
    w = weights
    return f"""{name}_parts AS (SELECT model, model_seq,
  coalesce(avg(least(accuracy_stressed / accuracy_original, 1e0)) FILTER (WHERE accuracy_original > 0), 0e0) AS retention,
  avg(prediction_agreement) AS stability,
  CASE WHEN count(*) > 1 THEN greatest(0e0, least(CASE WHEN avg(accuracy_stressed) <> 0
    THEN 1e0 - stddev_pop(accuracy_stressed) / avg(accuracy_stressed) ELSE 0e0 END, 1e0)) ELSE 1e0 END AS consistency
  FROM {source} GROUP BY model, model_seq),
{name} AS (SELECT model, model_seq, ({w['accuracy_retention']}::DOUBLE * retention + {w['prediction_stability']}::DOUBLE * stability
  + {w['performance_consistency']}::DOUBLE * consistency) * 100e0 AS overall_score, retention * 100e0 AS accuracy_retention,
  stability * 100e0 AS prediction_stability, consistency * 100e0 AS performance_consistency FROM {name}_parts)"""


DIMENSIONS = ("overall_score", "accuracy_retention", "prediction_stability", "performance_consistency")
SCORES = f"{SUITE}, {score_cte()}"


@query(
    "v1_upsert_results",
    f"""{SUITE}, latest AS (SELECT model, test_name, accuracy_original AS accuracy_stressed FROM stress_results WHERE test_seq BETWEEN 3 AND 8)
    SELECT model, test_name, {r6('accuracy_stressed')} AS accuracy_stressed FROM
    (SELECT model, test_name, accuracy_stressed FROM stress_results WHERE test_seq < 6
       AND (model, test_name) NOT IN (SELECT model, test_name FROM latest) UNION ALL SELECT * FROM latest)""",
)
def v1(spark, sf):
    """Earlier results of tests 0-5, then a rerun of tests 3-8 that lost no accuracy."""
    table = results(spark, sf).select("model", "test_seq", "test_name", "accuracy_original", "accuracy_stressed")
    old = table.filter(F.col("test_seq") < 6)
    new = table.filter(F.col("test_seq").between(3, 8)).withColumn("accuracy_stressed", F.col("accuracy_original"))
    return tidy(rb.upsert(old, new).select("model", "test_name", "accuracy_stressed"))


@query(
    "v1_stored_upsert",
    f"""{SUITE} SELECT model, test_name, {r6('CASE WHEN test_seq BETWEEN 3 AND 8 THEN accuracy_original ELSE accuracy_stressed END')} AS accuracy_stressed
    FROM stress_results WHERE test_seq <= 8""",
)
def v1_stored(spark, sf):
    """The same in a stored table, of which the rerun rewrites its own partitions only."""
    found = results(spark, sf).select("model", "test_seq", "test_name", "accuracy_original", "accuracy_stressed")
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    store = StoredTable(spark, path, found.schema, ["model", "test_name"]).put(found.filter(F.col("test_seq") < 6))
    store.put(found.filter(F.col("test_seq").between(3, 8)).withColumn("accuracy_stressed", F.col("accuracy_original")))
    return tidy(store.read().select("model", "test_name", "accuracy_stressed"))


@query("v2_robustness_score", f"{SCORES} SELECT model, {', '.join(f'{r6(c)} AS {c}' for c in DIMENSIONS)} FROM rs")
def v2(spark, sf):
    return tidy(rb.scores(results(spark, sf)).select("model", *DIMENSIONS))


CUSTOM = {"accuracy_retention": 0.6, "prediction_stability": 0.2, "performance_consistency": 0.2}


@query("v2_custom_weights", f"{SUITE}, {score_cte(CUSTOM)} SELECT model, {r6('overall_score')} AS overall_score FROM rs")
def v2_custom(spark, sf):
    return tidy(rb.scores(results(spark, sf), CUSTOM).select("model", "overall_score"))


VULNERABILITY = f"""SELECT model, test_name, {r6('performance_drop_pct')} AS drop_pct, {r6('performance_drop')} AS accuracy_loss,
  {r6('(1e0 - prediction_agreement) * 100e0')} AS changed_pct, {r6('accuracy_stressed')} AS accuracy_stressed,
  {r6('f1_stressed')} AS f1_stressed, {SEVERITY} AS severity FROM stress_results"""


@query("v3_vulnerability", f"{SUITE} {VULNERABILITY}")
def v3(spark, sf):
    return tidy(rb.vulnerability(results(spark, sf)).drop("test_seq"))


@query("v4_severity", f"{SUITE} SELECT model, {SEVERITY} AS severity, {big('count(*)')} AS n FROM stress_results GROUP BY ALL")
def v4(spark, sf):
    table = results(spark, sf).select("model", bands.severity(F.col("performance_drop_pct")).alias("severity"))
    return tidy(table.groupBy("model", "severity").agg(F.count(F.lit(1)).alias("n")))


WORDS_SQL = ", ".join(f"({text(c)}, {text(w)})" for c, words in rb.CATEGORIES.items() for w in words)
CATEGORY_SQL = f"""words(category, word) AS (VALUES {WORDS_SQL}),
placed AS (SELECT DISTINCT s.model, w.category, s.test_seq, s.performance_drop_pct, s.prediction_agreement FROM stress_results s
  JOIN words w ON contains(lower(s.test_name), w.word)),
cats AS (SELECT model, category, count(*) AS n, avg(performance_drop_pct) AS mean_drop, max(performance_drop_pct) AS max_drop,
  avg(prediction_agreement) AS agreement FROM placed GROUP BY model, category)"""


@query(
    "v5_category_summary",
    f"""{SUITE}, {CATEGORY_SQL} SELECT model, category, {big('n')} AS num_tests, {r6('mean_drop')} AS avg_drop_pct,
    {r6('max_drop')} AS max_drop_pct, {r6('agreement')} AS avg_agreement,
    {expected.category('mean_drop')} AS robustness FROM cats""",
)
def v5(spark, sf):
    return tidy(rb.category_summary(results(spark, sf)))


@query(
    "v6_compare_robustness",
    f"{SCORES} SELECT model, {', '.join(f'{r6(c)} AS {c}' for c in DIMENSIONS)} FROM rs WHERE model IN ('fix_a', 'fix_c')",
)
def v6(spark, sf):
    return tidy(rb.comparison(results(spark, sf), ["fix_a", "fix_c"]).select("model", *DIMENSIONS))


@query(
    "v7_kpis",
    f"""{SUITE}, sev AS (SELECT *, {SEVERITY} AS severity FROM stress_results),
    top AS (SELECT model, test_name FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY performance_drop_pct DESC, test_seq) AS rn
      FROM sev) WHERE rn = 1),
    agg AS (SELECT model, max(performance_drop_pct) AS worst, count(*) FILTER (WHERE severity = 'Critical') AS critical,
      count(*) FILTER (WHERE severity = 'High') AS high, avg(performance_drop_pct) AS mean_drop FROM sev GROUP BY model)
    SELECT model, CASE WHEN length(test_name) > 20 THEN substr(test_name, 1, 20) || '...' ELSE test_name END AS worst_test,
    {r6('worst')} AS worst_drop_pct, {big('critical + high')} AS high_risk, {big('critical')} AS critical, {big('high')} AS high,
    {r6('mean_drop')} AS avg_drop_pct FROM agg JOIN top USING (model)""",
)
def v7(spark, sf):
    return tidy(rb.kpis(results(spark, sf)))


BAND = expected.score_band("overall_score")


@query("v8_score_band", f"{SCORES} SELECT model, {r6('overall_score')} AS overall_score, {BAND} AS band FROM rs")
def v8(spark, sf):
    return tidy(rb.interpretation(rb.scores(results(spark, sf))).select("model", "overall_score", "band"))


@query(
    "v9_most_robust",
    f"{SCORES} SELECT model, {r6('round(overall_score, 1)')} AS overall_score FROM rs ORDER BY round(rs.overall_score, 1) DESC, model_seq LIMIT 1",
)
def v9(spark, sf):
    return tidy(rb.most_robust(rb.scores(results(spark, sf))))


def _recommendation_sql() -> str:
    shown = fixed("overall_score", 1)
    band = "CASE " + " ".join(
        f"WHEN {BAND} = {text(n)} THEN {text(h)} || {shown} || {text(t)}" for n, (h, t) in rb.BAND_LINES.items()
    ) + " END"
    rows = [
        f"SELECT model, 0 AS line, {band} AS text FROM rs",
        f"SELECT model, 1, {text(rb.KEY_HEADER)} FROM rs",
        f"""SELECT model, 9 + rk, '- **' || test_name || '**: ' || {fixed('performance_drop_pct', 1)} || '% drop (' || severity || ' severity)'
        FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY performance_drop_pct DESC, test_seq) AS rk FROM sev)
        WHERE rk <= 3 AND performance_drop_pct > 20""",
        f"SELECT DISTINCT model, 20, {text(rb.ACTION_HEADER)} FROM severe",
    ]
    at = 30
    for word, texts in rb.ACTIONS.items():
        for advice in texts:
            rows.append(f"SELECT DISTINCT model, {at}, {text(advice)} FROM severe WHERE contains(lower(test_name), '{word}')")
            at += 1
    head, tail = rb.STABILITY_LINE
    rows.append(
        f"SELECT model, 40, {text(head)} || {percent('prediction_stability / 100e0', 1)} || {text(tail)} FROM rs WHERE prediction_stability / 100e0 < 0.8::DOUBLE"
    )
    for i, advice in enumerate(rb.STABILITY_ADVICE):
        rows.append(f"SELECT model, {41 + i}, {text(advice)} FROM rs WHERE prediction_stability / 100e0 < 0.8::DOUBLE")
    rows.append(f"SELECT model, 0, {text(rb.NO_RESULTS)} FROM trained WHERE model NOT IN (SELECT model FROM rs)")
    body = " UNION ALL ".join(rows)
    return f"""{SCORES}, {fx.SQL_TRAINED}, sev AS (SELECT *, {SEVERITY} AS severity FROM stress_results),
    severe AS (SELECT * FROM sev WHERE severity IN ('High', 'Critical')), lines AS ({body})
    SELECT model, {big('line')} AS line, text FROM lines"""


@query("v10_recommendations", _recommendation_sql())
def v10(spark, sf):
    return tidy(rb.recommendations(results(spark, sf), fx.models(spark)))


@query(
    "v11_radar_data",
    SCORES
    + " UNION ALL ".join(
        f" SELECT model, '{label}' AS dimension, {r6(c)} AS value FROM rs"
        for label, c in [
            ("Accuracy Retention", "accuracy_retention"),
            ("Prediction Stability", "prediction_stability"),
            ("Performance Consistency", "performance_consistency"),
        ]
    ),
)
def v11_radar(spark, sf):
    return tidy(rb.radar(rb.scores(results(spark, sf))))


@query(
    "v11_heatmap_data",
    f"""{SUITE} SELECT model, test_name, 'drop' AS metric, {r6('round(performance_drop_pct, 2)')} AS value FROM stress_results
    UNION ALL SELECT model, test_name, 'changed', {r6('round((1e0 - prediction_agreement) * 100e0, 2)')} FROM stress_results""",
)
def v11_heatmap(spark, sf):
    return tidy(rb.heatmap(rb.vulnerability(results(spark, sf))))

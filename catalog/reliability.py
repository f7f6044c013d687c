"""Reliability score queries: three scored models and one without any evidence."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.functions.rounding import nearest
from plumbline.operators import reliability as rl
from plumbline.plans import scorecard
from plumbline.session import held

from . import expected
from . import fixtures as fx
from .base import big, fixed, query, r6, text, tidy
from .comparing import CERT, PERF_CTES, ROBUST

PARTS = [c.lower() for c in rl.COMPONENTS]

EVIDENCE = f"""{PERF_CTES}, {CERT}, {ROBUST},
ev AS (SELECT t.model, t.model_seq, m.accuracy, m.f1, cert.ece, d.avg_drop, cert.avg_entropy, cert.hce_rate, cert.n_classes
  FROM trained t LEFT JOIN (SELECT * FROM cm_metrics WHERE split = 'test') m ON m.model = t.model
  LEFT JOIN cert ON cert.model = t.model
  LEFT JOIN (SELECT model, avg(performance_drop) AS avg_drop FROM stress_results GROUP BY model) d ON d.model = t.model)"""


def scores_sql(base: str = "log2") -> str:
    top = f"{base}(greatest(coalesce(n_classes, 2), 2)::DOUBLE)"
    return f"""{EVIDENCE},
pts AS (SELECT *, CASE WHEN accuracy IS NULL OR f1 IS NULL THEN 12.5::DOUBLE ELSE round((accuracy + f1) / 2e0 * 25e0, 3) END AS performance,
  CASE WHEN ece IS NULL THEN 12.5::DOUBLE ELSE round(greatest(0e0, 1e0 - ece / 0.5::DOUBLE) * 25e0, 3) END AS calibration,
  CASE WHEN avg_drop IS NULL THEN 12.5::DOUBLE ELSE round(greatest(0e0, 1e0 - avg_drop / 0.5::DOUBLE) * 25e0, 3) END AS robustness,
  CASE WHEN avg_entropy IS NULL OR hce_rate IS NULL THEN 12.5::DOUBLE ELSE
    round((1e0 - least(avg_entropy / {top}, 1e0)) * 12.5::DOUBLE + greatest(0e0, 1e0 - hce_rate) * 12.5::DOUBLE, 3) END AS confidence FROM ev),
raw_tot AS (SELECT *, performance + calibration + robustness + confidence AS points FROM pts),
tot AS (SELECT *, {nearest('points', 2)} AS total,
  concat_ws(', ', CASE WHEN accuracy IS NULL OR f1 IS NULL THEN 'Performance' END, CASE WHEN ece IS NULL THEN 'Calibration' END,
    CASE WHEN avg_drop IS NULL THEN 'Robustness' END, CASE WHEN avg_entropy IS NULL OR hce_rate IS NULL THEN 'Confidence' END) AS lacking FROM raw_tot),
sc AS (SELECT *, {expected.grade('total')} AS grade FROM tot)"""


SCORES = scores_sql()


def evidence(spark, sf):
    cells = held(scorecard.evidence_cells(fx.predictions(spark, sf), fx.K))
    return scorecard.evidence(fx.models(spark), cells, fx.stored_results(spark, sf))


def scores(spark, sf):
    return rl.score(evidence(spark, sf))


def _component(name: str, column: str):
    @query(name, f"WITH {SCORES} SELECT model, {r6(column)} AS {column} FROM sc")
    def run(spark, sf):
        return tidy(scores(spark, sf).select("model", column))


_component("r1_performance_score", "performance")
_component("r2_calibration_score", "calibration")
_component("r3_robustness_score", "robustness")
_component("r4_confidence_score", "confidence")


@query(
    "r4_confidence_equal_units",
    f"WITH {scores_sql('ln')} SELECT model, {r6('confidence')} AS confidence FROM sc",
)
def r4_units(spark, sf):
    return tidy(rl.score(evidence(spark, sf), entropy_base=math.e).select("model", "confidence"))


def _score_columns():
    return f"{', '.join(f'{r6(c)} AS {c}' for c in PARTS)}, {r6('total')} AS total, grade"


@query(
    "r5_score_model",
    f"WITH {SCORES} SELECT model, {_score_columns()}, lacking AS missing_components FROM sc WHERE model = 'fix_b'",
)
def r5(spark, sf):
    one = scores(spark, sf).filter(F.col("model") == "fix_b")
    return tidy(one.select("model", *PARTS, "total", "grade", F.array_join("missing_components", ", ").alias("missing_components")))


@query("r6_grade", f"WITH {SCORES} SELECT model, {r6('total')} AS total, grade FROM sc")
def r6_grade(spark, sf):
    return tidy(scores(spark, sf).select("model", "total", "grade"))


@query("r7_score_all_models", f"WITH {SCORES} SELECT model, {_score_columns()}, lacking AS missing_components FROM sc")
def r7(spark, sf):
    return tidy(
        scores(spark, sf).select(
            "model", *PARTS, "total", "grade", F.array_join("missing_components", ", ").alias("missing_components")
        )
    )


EV_COLUMNS = ("accuracy", "f1", "ece", "avg_drop", "avg_entropy", "hce_rate")


@query(
    "r8_evidence",
    f"WITH {EVIDENCE} SELECT model, {', '.join(f'{r6(c)} AS {c}' for c in EV_COLUMNS)}, {big('n_classes')} AS n_classes FROM ev",
)
def r8(spark, sf):
    return tidy(evidence(spark, sf).select("model", *EV_COLUMNS, "n_classes"))


@query(
    "r9_summary_table",
    f"""WITH {SCORES} SELECT model, {fixed('total', 1)} AS total, grade, {', '.join(f"{fixed(c, 1, ' / 25')} AS {c}" for c in PARTS)},
    CASE WHEN lacking = '' THEN {text(rl.NOTHING_MISSING)} ELSE lacking END AS missing_data FROM sc""",
)
def r9(spark, sf):
    return rl.summary(scores(spark, sf))


def _advice_sql() -> str:
    cases = []
    for i, (component, steps) in enumerate(rl.ADVICE.items()):
        whens = " ".join(f"WHEN {component} < {limit} THEN {text(t)}" for limit, t in steps)
        cases.append(f"SELECT model, {i} AS pos, CASE {whens} END AS text FROM sc")
    return f"""adv AS (SELECT * FROM ({' UNION ALL '.join(cases)}) WHERE text IS NOT NULL)
    SELECT model, {big('row_number() OVER (PARTITION BY model ORDER BY pos) - 1')} AS line, text FROM adv
    UNION ALL SELECT model, 0, {text(rl.ALL_GOOD)} FROM sc WHERE model NOT IN (SELECT model FROM adv)"""


@query("r10_recommendations", f"WITH {SCORES}, {_advice_sql()}")
def r10(spark, sf):
    return tidy(rl.recommendations(scores(spark, sf)))


@query("r11_missing_components", f"WITH {SCORES} SELECT DISTINCT unnest(string_split(lacking, ', ')) AS component FROM sc WHERE lacking <> ''")
def r11(spark, sf):
    return rl.missing_components(scores(spark, sf))


@query("r12_best_model", f"WITH {SCORES} SELECT model, {r6('total')} AS total, grade FROM sc ORDER BY sc.total DESC, model_seq LIMIT 1")
def r12(spark, sf):
    return tidy(rl.best(scores(spark, sf)))


@query(
    "r13_raw_inputs",
    f"WITH {EVIDENCE} "
    + " UNION ALL ".join(
        f"SELECT model, {text(h)} AS metric, coalesce(CASE WHEN {c} IS NOT NULL THEN {fixed(c, 4)} END, 'N/A') AS value FROM ev"
        for c, h in rl.INPUTS.items()
    ),
)
def r13(spark, sf):
    return rl.raw_inputs(scores(spark, sf))


@query(
    "r14_radar_data",
    f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT model, '{c}' AS component, {r6(f'{c.lower()} / 25e0')} AS share FROM sc" for c in rl.COMPONENTS),
)
def r14_radar(spark, sf):
    return tidy(rl.radar(scores(spark, sf)))


@query(
    "r14_stacked_data",
    f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT model, '{c}' AS component, {r6(c.lower())} AS points FROM sc" for c in rl.COMPONENTS),
)
def r14_stacked(spark, sf):
    return tidy(rl.stacked(scores(spark, sf)))


COLOURS = expected.grade_colour("grade")


@query("r14_total_data", f"WITH {SCORES} SELECT model, {r6('total')} AS total, grade, {COLOURS} AS colour FROM sc")
def r14_total(spark, sf):
    return tidy(rl.total_series(scores(spark, sf)))

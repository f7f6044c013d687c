"""Golden values of hand-sized frames."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays, bands, binning
from plumbline.functions.rounding import nearest
from plumbline.operators import calibration, compare, confidence, evaluate, reliability, robustness
from plumbline.plans import scorecard


def approx(x, tol=1e-6):
    return pytest.approx(x, abs=tol)


def test_bins_and_calibration(golden):
    m = calibration.metrics(golden).first()
    assert (m.ece, m.mce, m.brier) == (approx(0.18), approx(0.4), approx(0.4455))
    assert (m.avg_accuracy, m.avg_confidence, m.overconfidence) == (approx(0.7), approx(0.73), approx(0.03))
    rows = {r.bin: (r.n, r.acc, r.conf) for r in calibration.bins(golden).collect()}
    assert len(rows) == 10
    assert rows[0] == (0, 0.0, 0.0)
    assert rows[4] == (2, approx(0.5), approx(0.4))
    assert rows[5] == (1, approx(1.0), approx(0.6))
    assert rows[6] == (2, approx(0.5), approx(0.7))
    assert rows[8] == (2, approx(0.5), approx(0.825))
    assert rows[9] == (3, approx(1.0), approx(0.95))


@pytest.mark.parametrize("k", [None, 3])
def test_unrolled_and_folded_formulas_agree(golden, k):
    m = calibration.metrics(golden, n_classes=k).first()
    assert m.brier == approx(0.4455)
    e = confidence.entropy_stats(golden, n_classes=k).first()
    assert e.mean_entropy == approx(0.639553)
    assert e.max_entropy == approx(1.088900)
    assert e.min_entropy == approx(4.605e-9, 1e-11)
    assert e.std_entropy == approx(0.342380)
    best = calibration.best_temperature(calibration.temperature_search(golden, n_classes=k)).first()
    assert (best.temperature, best.ece) == (approx(1.6), approx(0.133037))
    scaled = calibration.metrics(calibration.scale(golden, 2.0, k), n_classes=k).first()
    assert scaled.ece == approx(0.165726)


def test_bin_edges_follow_double_linspace(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (0.7,), (0.29999,), (1.0,), (0.0,)], "x double")
    got = [r.b for r in df.select(binning.bin_index(F.col("x"), 10).alias("b")).collect()]
    assert got == [2, 5, 6, 2, 9, 0]
    wide = [r.b for r in df.select(binning.bin_index(F.col("x"), 100).alias("b")).collect()]
    assert wide == [sum(e <= x for e in binning.edges(100)[1:-1]) for x in (0.3, 0.6, 0.7, 0.29999, 1.0, 0.0)]


def test_high_confidence_errors(golden):
    row = confidence.high_confidence_error_summary(golden, 0.8).first()
    assert (row.error_count, row.error_pct, row.avg_confidence) == (1, approx(10.0), approx(0.85))
    assert [r.row_id for r in confidence.high_confidence_errors(golden, 0.8).collect()] == [5]
    levels = {r.level: (r.n, r.accuracy) for r in confidence.threshold_split(golden, 0.8).collect()}
    assert levels == {"high": (5, approx(0.8)), "low": (5, approx(0.6))}
    none = confidence.high_confidence_error_summary(golden, 0.99).first()
    assert (none.error_count, none.avg_confidence) == (0, 0.0)


def test_evaluation(golden):
    matrix = {(r.y_true, r.y_pred): r.n for r in evaluate.confusion_matrix(golden).collect()}
    assert [[matrix[(i, j)] for j in range(3)] for i in range(3)] == [[2, 0, 0], [2, 2, 0], [0, 1, 3]]
    m = evaluate.metrics(golden).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (approx(0.7), approx(0.766667), approx(0.7), approx(0.704762))
    report = {r.label: r for r in evaluate.report(golden).collect()}
    assert [report[c].precision for c in "012"] == [approx(0.5), approx(2 / 3), approx(1.0)]
    assert [report[c].recall for c in "012"] == [approx(1.0), approx(0.5), approx(0.75)]
    assert report["macro avg"].f1 == approx(0.698413)
    assert report["accuracy"].support == approx(0.7)


def test_per_class(golden):
    got = [(r.ece, r.brier, r.avg_probability, r.prevalence) for r in calibration.per_class(golden).orderBy("class_index").collect()]
    assert got == [(0.25, 0.1205, 0.35, 0.2), (0.33, 0.2165, 0.32, 0.4), (0.19, 0.1085, 0.33, 0.4)]
    named = calibration.per_class(golden, class_names=["low", "mid"]).orderBy("class_index").collect()
    assert [r.class_name for r in named] == ["low", "mid", "Class 2"]
    assert calibration.worst_class(calibration.per_class(golden)).first().class_name == "Class 1"


def test_temperature_one_is_identity(golden):
    scaled = calibration.scale(golden, 1.0, 3).select("row_id", F.posexplode("proba").alias("i", "q"))
    plain = golden.select("row_id", F.posexplode("proba").alias("i", "p"))
    gap = scaled.join(plain, ["row_id", "i"]).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
    assert gap < 1e-9


def test_label_outside_range_has_no_one_hot(spark):
    df = spark.createDataFrame([(7, [0.5, 0.5])], "y int, p array<double>")
    for k in (None, 2):
        assert df.select(arrays.squared_error(F.col("p"), F.col("y"), k)).first()[0] == approx(0.5)


def test_robustness(stress_table):
    s = robustness.scores(stress_table).first()
    assert s.accuracy_retention == approx(87.333333)
    assert s.prediction_stability == approx(83.8)
    assert s.performance_consistency == approx(84.725972)
    assert s.overall_score == approx(85.491125)
    assert robustness.interpretation(robustness.scores(stress_table)).first().band == "Excellent"
    table = robustness.vulnerability(stress_table).collect()
    assert [r.severity for r in table] == ["Critical", "High", "Medium", "Low", "Low"]
    assert compare.linear_robustness(stress_table).first().robustness == approx(89.0)
    categories = {r.category: r.num_tests for r in robustness.category_summary(stress_table).collect()}
    assert categories == {"Noise": 1, "Dropout": 1, "Corruption": 1, "Scaling": 1, "Distribution": 1}
    k = robustness.kpis(stress_table).first()
    assert (k.worst_test, k.high_risk, k.critical) == ("Feature Dropout (30%...", 2, 1)


def test_recommendation_lines(spark, stress_table):
    models = spark.createDataFrame([("m", 0), ("idle", 1)], "model string, model_seq int")
    lines = robustness.recommendations(stress_table, models).orderBy("model", "line").collect()
    assert [r.text for r in lines if r.model == "idle"] == [robustness.NO_RESULTS]
    mine = [r.text for r in lines if r.model == "m"]
    assert mine[0].startswith("✅ **Excellent robustness** (score: 85.5/100)")
    assert "- **Feature Dropout (30%)**: 33.3% drop (Critical severity)" in mine
    assert "- **Scale Perturbation (2.0x)**: 22.2% drop (High severity)" in mine
    assert sum("Corruption" in t for t in mine) == 0
    assert [t for t in mine if "dropout regularization" in t] and [t for t in mine if "scale-invariant" in t]


EVIDENCE = (
    "model string, model_seq int, accuracy double, f1 double, ece double, avg_drop double, "
    "avg_entropy double, hce_rate double, n_classes int"
)


def test_reliability_scores(spark):
    df = spark.createDataFrame(
        [
            ("a", 0, 0.9, 0.89, 0.05, 0.11, 0.35, 0.04, 3),
            ("b", 1, 0.9, 0.89, 0.0, -0.1, 0.0, 0.0, 2),
            ("c", 2, None, None, None, None, None, None, None),
        ],
        EVIDENCE,
    )
    a, b, c = reliability.score(df).orderBy("model_seq").collect()
    assert (a.performance, a.calibration, a.robustness, a.confidence) == (22.375, 22.5, 19.5, approx(21.74))
    assert (a.total, a.grade, a.colour) == (approx(86.11), "A", "#27AE60")
    assert (b.performance, b.calibration, b.robustness, b.confidence) == (22.375, 25.0, 30.0, 25.0)
    assert (b.total, b.grade) == (approx(102.38), "A+")
    assert (c.total, c.grade, c.missing_components) == (50.0, "D", list(reliability.COMPONENTS))
    shown = {r.model: r.missing_data for r in reliability.summary(reliability.score(df)).collect()}
    assert shown == {"a": "—", "b": "—", "c": "Performance, Calibration, Robustness, Confidence"}
    advice = reliability.recommendations(reliability.score(df)).filter("model = 'a'").collect()
    assert [r.text for r in advice] == [reliability.ALL_GOOD]
    equal_units = reliability.score(df, math.e).filter("model = 'a'").first()
    assert equal_units.confidence == approx(round((1 - 0.35 / math.log(3)) * 12.5 + 0.96 * 12.5, 3), 1e-3)


def test_composite(spark):
    perf = spark.createDataFrame([("a", 0, 0.9, 0.89, True)], "model string, model_seq int, accuracy double, f1 double, has_data boolean")
    rob = spark.createDataFrame([("a", 88.0)], "model string, robustness double")
    ece = spark.createDataFrame([("a", 0.05)], "model string, ece double")
    assert compare.composite(perf, rob, ece).first().composite == approx(90.5)
    assert compare.composite(perf, None, ece).first().composite == approx(90.88)
    assert compare.composite(perf).first().composite == approx(89.5)
    assert compare.recommend(compare.composite(perf, rob, ece)).first().runner_up is None
    assert compare.recommend(compare.composite(perf.filter("has_data = false"))).count() == 0


def test_band_limits(spark):
    df = spark.createDataFrame([(x,) for x in (4.999, 5.0, 15.0, 30.0, -1.0)], "x double")
    assert [r[0] for r in df.select(bands.severity(F.col("x"))).collect()] == ["Low", "Medium", "High", "Critical", "Low"]
    q = spark.createDataFrame([(x,) for x in (0.0299, 0.03, 0.07, 0.15)], "x double")
    assert [r[0] for r in q.select(bands.calibration_quality(F.col("x"))).collect()] == ["Excellent", "Good", "Moderate", "Poor"]
    g = spark.createDataFrame([(x,) for x in (90.0, 80.0, 70.0, 60.0, 50.0, 49.9)], "x double")
    assert [r[0] for r in g.select(bands.grade(F.col("x"))).collect()] == ["A+", "A", "B", "C", "D", "F"]


def test_scorecard_evidence(spark, golden, stress_table):
    models = spark.createDataFrame([("m", 0), ("idle", 1)], "model string, model_seq int")
    cells = scorecard.evidence_cells(golden, 3)
    e = scorecard.evidence(models, cells, stress_table).filter("model = 'm'").first()
    assert (e.accuracy, e.f1, e.ece, e.avg_drop) == (approx(0.7), approx(0.704762), approx(0.18), approx(0.11))
    assert (e.avg_entropy, e.hce_rate, e.n_classes) == (approx(0.639553), 0.0, 3)
    assert scorecard.scorecard(models, golden, stress_table, n_classes=3).count() == 2


def test_ties_follow_the_true_value(spark):
    import random

    rng = random.Random(5)
    values = [86.115, 90.875, 0.125, 0.375, -86.115, 2.675, 1.005, 0.0] + [rng.randrange(0, 200000) / 1000 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", F.expr(nearest("x", 2)).alias("r")).collect()
    assert all(r.r == round(r.x, 2) for r in got)

"""Edge frames: empty, single-row, constant, all-null, boundary inputs."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, compare, evaluate, profile, robustness, stress
from plumbline.operators.stress import StressTest


def test_strategy_order_changes_the_mean(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (5.0, None)], "v double, c string")
    after = clean.fill(df, {"c": "drop", "v": "mean"}).collect()
    before = clean.fill(df, {"v": "mean", "c": "drop"}).collect()
    assert sorted(r.v for r in after) == [1.0, 1.0]
    assert sorted(r.v for r in before) == [1.0, 3.0]


def test_fill_kinds(spark):
    df = spark.createDataFrame([(1, 2.0, "b"), (None, None, None), (4, 6.0, "a"), (None, 7.0, "a"), (2, 1.0, "b")], "i int, v double, c string")
    assert clean.fill(df, {"i": "mean"}).filter("i > 2.3 and i < 2.4").count() == 2
    assert clean.fill(df, {"v": "median"}).filter("v = 4.0").count() == 1
    assert clean.fill(df, {"c": "mode"}).filter("c = 'a'").count() == 3
    assert clean.fill(df, {"c": "other", "nowhere": "mean"}).filter("c = 'other'").count() == 1
    with pytest.raises(ValueError):
        clean.fill(df, {"v": "forward_fill"})


def test_mode_of_nothing_fails_clearly(spark):
    df = spark.createDataFrame([(None,), (None,)], "c string")
    with pytest.raises(ValueError, match="mode"):
        clean.fill(df, {"c": "mode"})


def test_leading_and_trailing_nulls_stay(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "k int, v double")
    ahead = {r.k: r.v for r in clean.fill(df, {"v": "forward_fill"}, ["k"]).collect()}
    back = {r.k: r.v for r in clean.fill(df, {"v": "backward_fill"}, ["k"]).collect()}
    assert ahead == {1: None, 2: 5.0, 3: 5.0} and back == {1: 5.0, 2: 5.0, 3: None}


def test_menu(spark):
    df = spark.createDataFrame([(1.0, "a")], "v double, c string")
    clean.check_strategies(df, {"v": "median", "c": "mode"})
    with pytest.raises(ValueError):
        clean.check_strategies(df, {"c": "mean"})
    with pytest.raises(ValueError):
        clean.check_strategies(df, {"v": "mode"})


def test_profile_of_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert [r.missing_pct for r in profile.missing(empty).collect()] == [None, None]
    assert profile.duplicates(empty).first()[0] == 0
    assert profile.shape(empty).first().rows == 0
    assert {r.column: r.distinct for r in profile.column_info(empty).collect()} == {"a": 0, "b": 0}
    one = spark.createDataFrame([(3, "x", True)], "a int, b string, c boolean")
    d = profile.describe(one).first()
    assert (d["count"], d["mean"], d["std"], d.p25, d.p75) == (1, 3.0, None, 3.0, 3.0)
    assert profile.numeric_columns(one) == ["a"] and profile.categorical_columns(one) == ["b"]
    assert set(profile.validate(one)) >= {"shape", "missing", "duplicates", "size_mb"}


RESULT = (
    "model string, model_seq int, test_seq int, test_name string, accuracy_original double, accuracy_stressed double, "
    "performance_drop double, performance_drop_pct double, f1_stressed double, prediction_agreement double"
)


def result(spark, rows):
    return spark.createDataFrame([("m", 0, i, n, a, b, a - b, 0.0 if a == 0 else (a - b) / a * 100, b, g) for i, (n, a, b, g) in enumerate(rows)], RESULT)


def test_score_corner_cases(spark):
    one = robustness.scores(result(spark, [("t", 0.8, 0.4, 1.0)])).first()
    assert (one.performance_consistency, one.accuracy_retention) == (100.0, 50.0)
    zero = robustness.scores(result(spark, [("t", 0.5, 0.0, 0.0), ("u", 0.5, 0.0, 0.0)])).first()
    assert zero.performance_consistency == 0.0
    skipped = robustness.scores(result(spark, [("t", 0.0, 0.5, 1.0), ("u", 0.0, 0.5, 1.0)])).first()
    assert skipped.accuracy_retention == 0.0
    models = spark.createDataFrame([("m", 0), ("idle", 1)], "model string, model_seq int")
    listed = robustness.scores_for(models, result(spark, [("t", 0.8, 0.4, 1.0)]))
    assert {r.model: r.overall_score > 0 for r in listed.collect()} == {"m": True, "idle": False}


def test_name_in_two_categories(spark):
    table = robustness.category_summary(result(spark, [("gaussian scale", 0.9, 0.8, 0.9), ("plain", 0.9, 0.8, 0.9)]))
    assert {r.category for r in table.collect()} == {"Noise", "Scaling"}


def test_upsert_keeps_or_replaces(spark):
    old = result(spark, [("a", 0.9, 0.8, 1.0), ("b", 0.9, 0.7, 1.0)])
    new = result(spark, [("b", 0.9, 0.9, 1.0)])
    assert {(r.test_name, r.accuracy_stressed) for r in robustness.upsert(old, new).collect()} == {("a", 0.8), ("b", 0.9)}
    assert robustness.upsert(old, new, replace=True).count() == 1


def test_model_without_metrics_and_ties(spark):
    models = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "model string, model_seq int")
    metrics = spark.createDataFrame(
        [("a", 0, "test", 0.8, 0.8, 0.8, 0.8), ("b", 1, "test", 0.8, 0.8, 0.8, 0.8)],
        "model string, model_seq int, split string, accuracy double, precision double, recall double, f1 double",
    )
    table = compare.performance(models, metrics)
    assert {r.model: r.has_data for r in table.collect()} == {"a": True, "b": True, "c": False}
    assert evaluate.best(metrics, "f1").first().model == "a"
    assert compare.recommend(compare.composite(table)).first().best_model == "a"
    with pytest.raises(ValueError):
        evaluate.best(metrics, "auc")


def test_stress_configs(spark):
    assert len(stress.DEFAULT_SUITE) == 19 and len({t.title for t in stress.DEFAULT_SUITE}) == 19
    kept = stress.usable([StressTest("gaussian_noise"), StressTest("nonsense"), StressTest("gaussian_noise", {"noise_level": 0.9})])
    assert [(t.title, stress.amount(t)) for t in kept] == [("gaussian_noise", 0.9)]
    for bad in (
        StressTest("nonsense"),
        StressTest("gaussian_noise", {"noise_level": 1.5}),
        StressTest("feature_corruption", {"corruption_type": "odd"}),
        StressTest("distribution_shift", {"shift_type": "odd"}),
        StressTest("scale_perturbation", {"scale_factor": 0.5}),
    ):
        with pytest.raises(ValueError):
            stress.check(bad)


def test_zero_original_accuracy_has_no_drop(spark):
    rows = spark.createDataFrame([("m", 0, "test", 0, "t", 1, 0, 1), ("m", 0, "test", 0, "t", 1, 0, 0)],
        "model string, model_seq int, split string, test_seq int, test_name string, y_true int, y_pred_original int, y_pred_stressed int")
    r = stress.results(rows).first()
    assert (r.accuracy_original, r.performance_drop_pct, r.accuracy_stressed, r.prediction_agreement) == (0.0, 0.0, 0.5, 0.5)


def test_null_features_stay_null_unless_corrupted(spark):
    df = spark.range(200).selectExpr("id AS row_id", "CASE WHEN id % 5 = 0 THEN NULL ELSE cast(id AS double) END AS x")
    dropped = stress.perturb(df, ["x"], [StressTest("feature_dropout", {"dropout_rate": 0.5})])
    assert dropped.filter("x IS NULL").count() == 40
    hit = stress.perturb(df, ["x"], [StressTest("feature_corruption", {"corruption_rate": 0.5})])
    assert hit.filter("x = 0").count() == 100
    with pytest.raises(ValueError):
        stress.perturb(df.withColumn("x", F.lit(None).cast("double")), ["x"], [StressTest("gaussian_noise")])

"""Perturbation and stress-test queries. All run over every row of ``orders``."""

from __future__ import annotations

from plumbline.operators import stress
from plumbline.operators.stress import StressTest
from plumbline.sources import sinks

from . import fixtures as fx
from .base import fixed, percent, query, r6, rounded, tidy

SINGLE = {
    "t1_gaussian_noise": StressTest("gaussian_noise", {"noise_level": 0.1}),
    "t2_uniform_noise": StressTest("uniform_noise", {"noise_range": 0.1}),
    "t3_feature_dropout": StressTest("feature_dropout", {"dropout_rate": 0.2}),
    "t4a_corruption_zero": StressTest("feature_corruption", {"corruption_rate": 0.1, "corruption_type": "zero"}),
    "t4b_corruption_mean": StressTest("feature_corruption", {"corruption_rate": 0.1, "corruption_type": "mean"}),
    "t4c_corruption_random": StressTest("feature_corruption", {"corruption_rate": 0.1, "corruption_type": "random"}),
    "t4d_corruption_extreme": StressTest("feature_corruption", {"corruption_rate": 0.1, "corruption_type": "extreme"}),
    "t5_scale_perturbation": StressTest("scale_perturbation", {"scale_factor": 1.5}),
    "t6a_mean_shift": StressTest("distribution_shift", {"shift_type": "mean", "shift_amount": 0.5}),
    "t6b_variance_shift": StressTest("distribution_shift", {"shift_type": "variance", "shift_amount": 0.5}),
}


def _single(name: str, test: StressTest):
    sql = f"""WITH {fx.SQL_FEATURES}, {fx.stressed_features_sql([test])}
    SELECT row_id, {rounded('s1', 9)} AS x_1, {rounded('s2', 9)} AS x_2, {rounded('s3', 9)} AS x_3 FROM stressed"""

    @query(name, sql)
    def run(spark, sf):
        moved = stress.perturb(fx.evaluation_rows(spark, sf), fx.FEATURES, [test], seed=fx.SEED)
        return tidy(moved.select("row_id", *fx.FEATURES), 9)


for _name, _test in SINGLE.items():
    _single(_name, _test)

NUMBERS = (
    "accuracy_original",
    "accuracy_stressed",
    "performance_drop",
    "performance_drop_pct",
    "precision_stressed",
    "recall_stressed",
    "f1_stressed",
    "prediction_agreement",
)
ONE = [StressTest("uniform_noise", {"noise_range": 0.3}, "Uniform Noise (High)")]
COLUMNS = f"model, split, test_name, {', '.join(f'{r6(c)} AS {c}' for c in NUMBERS)}"
SUITE = f"WITH {fx.stress_results_ctes()}"


@query("t7_evaluate_stress_test", f"WITH {fx.stress_results_ctes(ONE)} SELECT {COLUMNS} FROM stress_results")
def t7(spark, sf):
    return tidy(fx.stress_results(spark, sf, ONE).select("model", "split", "test_name", *NUMBERS))


@query("t8_batch_stress_test", f"{SUITE} SELECT {COLUMNS} FROM stress_results")
def t8(spark, sf):
    return tidy(fx.stress_results(spark, sf).select("model", "split", "test_name", *NUMBERS))


@query(
    "t11_batch_summary",
    f"""{SUITE} SELECT model, test_name, {percent('accuracy_original', 2)} AS original_acc, {percent('accuracy_stressed', 2)} AS stressed_acc,
    {fixed('performance_drop_pct', 1, '%')} AS drop_pct, {percent('prediction_agreement', 2)} AS agreement, {percent('f1_stressed', 2)} AS f1
    FROM stress_results""",
)
def t11(spark, sf):
    return stress.summary(fx.stress_results(spark, sf))


@query(
    "t12_chart_series",
    SUITE
    + " UNION ALL ".join(
        f" SELECT model, test_name, '{s}' AS series, {r6(c)} AS value FROM stress_results"
        for s, c in [
            ("drop", "performance_drop_pct"),
            ("original", "accuracy_original * 100"),
            ("stressed", "accuracy_stressed * 100"),
            ("agreement", "prediction_agreement * 100"),
        ]
    ),
)
def t12(spark, sf):
    return tidy(stress.series(fx.stress_results(spark, sf)))


@query(
    "t13_most_challenging",
    f"""{SUITE} SELECT test_name, {fixed('performance_drop_pct', 1, '%')} AS performance_drop, {percent('accuracy_stressed', 2)} AS stressed_accuracy
    FROM (SELECT * FROM stress_results WHERE model = 'fix_b' ORDER BY performance_drop_pct DESC, test_seq LIMIT 5)""",
)
def t13(spark, sf):
    return stress.most_challenging(fx.stress_results(spark, sf), "fix_b")


@query(
    "s7_stress_results_export",
    f"""{SUITE} SELECT model AS "Model", split AS "Dataset", test_name AS "Stress_Test", """
    + ", ".join(f'{r6(c)} AS "{c.title()}"' for c in NUMBERS)
    + " FROM stress_results",
)
def s7(spark, sf):
    return tidy(sinks.stress_export(fx.stress_results(spark, sf)))

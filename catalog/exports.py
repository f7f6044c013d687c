"""Exports as they come back from their files, and the small rule tables. Every file is written and read again."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import arrays
from plumbline.operators import calibration, clean, confidence, features, models, profile, report, robustness, stress
from plumbline.operators.stress import StressTest
from plumbline.plans import scorecard
from plumbline.session import shared_folder
from plumbline.sources import artifacts, readers, sinks

from . import calibrating, fixtures as fx, reporting, robustness as robustness_queries, stressing, training
from .base import REGISTRY, big, query, r6, table, tidy
from .profiling import EVENTS_SQL, events_missing


def scratch(spark) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"


def returned(spark, df):
    """``df`` from the CSV it was written to."""
    path = scratch(spark)
    sinks.write_csv(df, path)
    return readers.read_csv(spark, path)


@query(
    "s1_read_csv",
    r"""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'say "' || c_name || '", ok' || chr(10) || 'and, more' END AS note,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey::BIGINT END AS nation,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE round(c_acctbal, 6) END AS balance, c_custkey % 2 = 0 AS even FROM customer""",
)
def s1(spark, sf):
    """Quotes, commas, line breaks and missing-value words, through a file and type inference."""
    missing = lambda n, c, word: F.when(F.col("c_custkey") % n == 0, F.lit(word)).otherwise(c.cast("string"))
    note = F.concat(F.lit('say "'), "c_name", F.lit('", ok\nand, more'))
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        missing(5, note, "N/A").alias("note"),
        missing(3, F.col("c_nationkey"), "NA").alias("nation"),
        missing(4, F.col("c_acctbal"), "NaN").alias("balance"),
        (F.col("c_custkey") % 2 == 0).alias("even"),
    )
    return tidy(returned(spark, df))


@query(
    "s4_artifact_listing",
    """SELECT * FROM (VALUES ('logistic_regression', 'Logistic Regression'), ('second_model', 'Second Model')) AS t(folder, display_name)
    WHERE (SELECT count(*) FROM embeddings) > 0""",
)
def s4(spark, sf):
    book, root = models.ModelBook(), scratch(spark)
    book.train(models.LOGISTIC, training.train_rows(training.rows(spark, sf)), training.COLUMNS)
    for name in ("Logistic Regression", "Second Model"):
        book.save(models.LOGISTIC, artifacts.artifact_path(root, name))
    return artifacts.list_models(spark, root)


HEADINGS = 'true_label AS "True_Label", predicted_label AS "Predicted_Label", confidence AS "Confidence", correct AS "Correct"'


@query("s5_predictions_export", f"SELECT {HEADINGS} FROM ({REGISTRY['q6_confidence_frame'].sql})")
def s5(spark, sf):
    return tidy(returned(spark, sinks.predictions_export(confidence.confidence_frame(fx.predictions(spark, sf)))))


@query("s6_high_confidence_errors_export", f"SELECT {HEADINGS} FROM ({REGISTRY['q4_high_confidence_error_rows'].sql})")
def s6(spark, sf):
    return tidy(returned(spark, sinks.predictions_export(confidence.high_confidence_errors(fx.predictions(spark, sf), 0.8))))


@query("s8_vulnerability_export", REGISTRY["v3_vulnerability"].sql)
def s8(spark, sf):
    return tidy(returned(spark, robustness.vulnerability(robustness_queries.results(spark, sf)).drop("test_seq")))


@query("s9_calibration_export", REGISTRY["k9_metric_table"].sql)
def s9(spark, sf):
    return tidy(returned(spark, calibration.table(calibrating.measures(spark, sf), calibrating.KEYS)))


@query("s10_recommendations_export", f"SELECT unnest(string_split(text, chr(10))) AS value FROM ({REGISTRY['v10_recommendations'].sql})")
def s10(spark, sf):
    path = scratch(spark)
    lines = robustness.recommendations(robustness_queries.results(spark, sf), fx.models(spark))
    sinks.write_lines(lines, "text", ["model", "line"], path)
    return spark.read.text(path)


@query("s12_performance_export", REGISTRY["x1_performance_section"].sql)
def s12_performance(spark, sf):
    section = report.performance(fx.models(spark), scorecard.metrics(reporting.cells(spark, sf)))
    return tidy(returned(spark, section))


@query("s12_robustness_export", REGISTRY["x2_robustness_section"].sql)
def s12_robustness(spark, sf):
    return tidy(returned(spark, report.robustness(fx.models(spark), fx.stored_results(spark, sf))))


@query("s12_reliability_export", REGISTRY["x4_reliability_section"].sql)
def s12_reliability(spark, sf):
    return tidy(returned(spark, reporting.everything(spark, sf)[1]["reliability"]))


def _class_sql(column: str, kind: str) -> str:
    total = r6(f"sum({column})") if kind == "numeric" else "NULL::DOUBLE"
    values = "NULL::BIGINT" if kind == "numeric" else big(f"count(DISTINCT {column})")
    return f"""SELECT '{column}' AS "column", '{kind}' AS class, {big(f'count({column})')} AS filled, {total} AS total, {values} AS distinct_values FROM events_missing"""


@query(
    "p7_column_classes",
    f"WITH {EVENTS_SQL} "
    + " UNION ALL ".join(
        _class_sql(c, k)
        for c, k in (("event_id", "numeric"), ("user_id", "numeric"), ("value_n", "numeric"), ("event_type_n", "categorical"), ("props", "categorical"))
    ),
)
def p7(spark, sf):
    """Numeric and categorical columns with what can be said of each kind: filled values, and their sum or how many there are."""
    rows = events_missing(spark, sf)
    parts = []
    for kind, columns in (("numeric", profile.numeric_columns(rows)), ("categorical", profile.categorical_columns(rows))):
        for c in columns:
            total = F.sum(c).cast("double") if kind == "numeric" else F.lit(None).cast("double")
            values = F.lit(None).cast("long") if kind == "numeric" else F.count_distinct(c)
            part = rows.agg(F.count(c).alias("filled"), total.alias("total"), values.alias("distinct_values"))
            parts.append(part.select(F.lit(c).alias("column"), F.lit(kind).alias("class"), "*"))
    return tidy(reduce(DataFrame.unionByName, parts))


_STATES = {
    "mean": "coalesce(value_n, (SELECT avg(value_n) FROM events_missing))",
    "median": "coalesce(value_n, (SELECT quantile_cont(value_n, 0.5) FROM events_missing))",
    "mode": "coalesce(event_type_n, (SELECT event_type_n FROM events_missing WHERE event_type_n IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))",
    "drop": "{c}",
    "forward_fill": "coalesce({c}, last_value({c} IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING))",
    "backward_fill": "coalesce({c}, first_value({c} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
}
_MENUS = {"value_n": ("mean", "median", "drop", "forward_fill", "backward_fill"), "event_type_n": ("mode", "drop", "forward_fill", "backward_fill")}


def _menu_sql(column: str, strategy: str) -> str:
    value = _STATES[strategy].format(c=column)
    where = f"WHERE {column} IS NOT NULL" if strategy == "drop" else ""
    total = r6("sum(v)") if column == "value_n" else r6("sum(length(v) * (event_id % 13))")
    return f"""SELECT '{column}' AS "column", '{strategy}' AS strategy, {big('count(*)')} AS rows, {big('count(*) - count(v)')} AS missing,
    {total} AS total FROM (SELECT event_id, {value} AS v FROM events_missing {where})"""


@query("c10_strategy_menu", f"WITH {EVENTS_SQL} " + " UNION ALL ".join(_menu_sql(c, m) for c, ms in _MENUS.items() for m in ms))
def c10(spark, sf):
    """Every strategy that a column's menu offers, carried out: rows, values still missing and a sum over the result."""
    rows = events_missing(spark, sf).select("event_id", "event_type_n", "value_n")
    parts = []
    for c in ("value_n", "event_type_n"):
        for m in clean.menu(rows, c):
            done = clean.fill(rows, {c: m}, order_by=["event_id"])
            total = F.sum(c) if c == "value_n" else F.sum(F.length(c) * (F.col("event_id") % 13)).cast("double")
            part = done.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), total.alias("total"))
            parts.append(part.select(F.lit(c).alias("column"), F.lit(m).alias("strategy"), "*"))
    return tidy(reduce(DataFrame.unionByName, parts))


@query("f3_select_features", "SELECT * EXCLUDE (o_orderstatus) REPLACE (round(o_totalprice, 6) AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate) FROM orders")
def f3(spark, sf):
    orders = table(spark, sf, "orders")
    chosen = orders.select(features.select_features(orders, "o_orderstatus"))
    return tidy(chosen.withColumn("o_orderdate", F.col("o_orderdate").cast("string")))


@query("m3b_unknown_model", "SELECT 'Unknown model: Perceptron' AS message, count(*) AS rows FROM embeddings")
def m3b(spark, sf):
    rows = training.rows(spark, sf)
    try:
        models.fit("Perceptron", rows, training.COLUMNS)
    except ValueError as refused:
        return rows.agg(F.lit(str(refused)).alias("message"), F.count(F.lit(1)).alias("rows"))
    raise AssertionError("an unknown model was accepted")


@query(
    "t9_default_suite",
    f"""WITH {fx.SQL_FEATURES}, {fx.stressed_features_sql()} SELECT test_name, {big('count(*)')} AS rows,
    {', '.join(f"{r6(f'avg(s{j})')} AS mean_{j}, {r6(f'stddev_pop(s{j})')} AS spread_{j}, {r6(f'max(s{j})')} AS top_{j}" for j in (1, 2, 3))}
    FROM stressed GROUP BY test_name""",
)
def t9(spark, sf):
    """Mean, deviation and maximum of every perturbed feature under each of the 19 tests."""
    moved = stress.perturb(fx.evaluation_rows(spark, sf), fx.FEATURES, stress.DEFAULT_SUITE, seed=fx.SEED)
    measures = {"mean": F.avg, "spread": F.stddev_pop, "top": F.max}
    aggs = [f(c).alias(f"{m}_{j}") for j, c in enumerate(fx.FEATURES, 1) for m, f in measures.items()]
    return tidy(moved.groupBy("test_name").agg(F.count(F.lit(1)).alias("rows"), *aggs))


@query("t10_single_test", REGISTRY["t7_evaluate_stress_test"].sql)
def t10(spark, sf):
    """One test within its range; one outside is refused."""
    [test] = stressing.ONE
    try:
        stress.check(StressTest("uniform_noise", {"noise_range": 0.6}))
    except ValueError:
        found = stress.single(fx.SCORERS, fx.evaluation_rows(spark, sf), fx.FEATURES, test, seed=fx.SEED)
        return tidy(found.select("model", "split", "test_name", *stressing.NUMBERS))
    raise AssertionError("a noise range above the limit was accepted")


def _by_split() -> str:
    parts = []
    for name in ("test", "validation"):
        feat = f"feat AS (SELECT * FROM (WITH {fx.SQL_FEATURES} SELECT * FROM feat) WHERE split = '{name}')"
        results = f"WITH {feat}, {fx.SQL_MODELS}, {fx.stress_results_ctes(base=False)} SELECT * REPLACE ('{name}' AS split) FROM stress_results"
        parts.append(f"SELECT {stressing.COLUMNS} FROM ({results})")
    return " UNION ALL ".join(parts)


@query("t8_batch_by_split", _by_split())
def t8_by_split(spark, sf):
    """Two splits in one run, each with its own statistics and numbers of corrupted cells."""
    rows = fx.features(spark, sf).withColumn("y", F.expr(fx.STRESS_LABEL)).filter("split <> 'train'")
    found = stress.run(fx.SCORERS, rows, fx.FEATURES, seed=fx.SEED)
    return tidy(found.select("model", "split", "test_name", *stressing.NUMBERS))


WIDE = [round(0.02 * (i % 7) / 7 + 0.001 * i, 6) for i in range(40)]
WIDE_SQL = "[" + ", ".join(f"({v!r}::DOUBLE * (1e0 + o_orderkey % 5))" for v in WIDE) + "]"


@query(
    "q2_entropy_many_classes",
    f"""WITH p AS (SELECT o_orderkey, list_transform(w, lambda x: x / list_sum(w)) AS p FROM (SELECT o_orderkey, {WIDE_SQL} AS w FROM orders))
    SELECT o_orderkey, {r6('-list_sum(list_transform(p, lambda x: least(greatest(x, 1e-10::DOUBLE), 1e0) * ln(least(greatest(x, 1e-10::DOUBLE), 1e0))))')} AS entropy,
    {big('len(p)')} AS classes FROM p""",
)
def q2_many(spark, sf):
    """Forty classes, with and without the hint, give one entropy."""
    w = F.array(*[F.lit(v) * (1 + F.col("o_orderkey") % 5) for v in WIDE])
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    p = table(spark, sf, "orders").select("o_orderkey", w.alias("w")).select("o_orderkey", F.transform("w", lambda x: x / total).alias("p"))
    both = F.when(F.abs(arrays.entropy(F.col("p"), 40) - arrays.entropy(F.col("p"))) < 1e-9, arrays.entropy(F.col("p"), 40))
    return tidy(p.select("o_orderkey", both.alias("entropy"), F.size("p").alias("classes")))


@query(
    "c7_forward_fill_null_keys",
    f"""SELECT event_id, user_id, {r6('last_value(v IGNORE NULLS) OVER (ORDER BY k NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS v
    FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v,
          CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS k FROM events)""",
)
def c7_null_keys(spark, sf):
    """A text order key with nulls, over many ranges."""
    rows = table(spark, sf, "events").select(
        "event_id", "user_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("k"),
    )
    return tidy(clean.directional_fill(rows, {"v": "forward_fill"}, ["k", "event_id"]).select("event_id", "user_id", "v"))


@query(
    "f2_one_hot_index",
    """SELECT c_custkey, CASE WHEN place > 1 THEN place - 2 END AS c_name FROM
    (SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) AS place FROM customer)""",
)
def f2_index(spark, sf):
    """The sparse form, on a column with a category per row."""
    encoded, _ = features.one_hot_index(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"])
    return tidy(encoded)


@query(
    "f5_split_summary_many_classes",
    f"""SELECT split, class, class_count, samples, {r6('samples * 100e0 / (SELECT count(*) FROM customer)')} AS percentage FROM
    (SELECT split, class, count(*) AS class_count, sum(count(*)) OVER (PARTITION BY split) AS samples FROM
     (SELECT CASE WHEN c_custkey % 10 < 2 THEN 'test' WHEN c_custkey % 10 = 2 THEN 'validation' ELSE 'train' END AS split, c_name AS class FROM customer) GROUP BY split, class)""",
)
def f5_many(spark, sf):
    """A target with a class per row."""
    part = F.when(F.col("c_custkey") % 10 < 2, "test").when(F.col("c_custkey") % 10 == 2, "validation").otherwise("train")
    return tidy(features.split_summary(table(spark, sf, "customer").select("c_name", part.alias("split")), "c_name"))

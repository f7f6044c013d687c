"""Shared fixture: three fixed-coefficient softmax scorers over ``orders``.

The scorers need no training, so the same probabilities come out of Spark and of SQL. All rows
of ``orders`` are scored; the split of a row is a keyed draw on its order key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import keyed
from plumbline.operators import scoring, stress
from plumbline.session import shared_folder, small_frame
from plumbline.sources.stored import StoredTable

from .base import (
    digest,
    bent_sql,
    fine_uniform_sql,
    line_sql,
    mix_sql,
    num,
    open_uniform_sql,
    table,
    text,
    uniform,
    words_sql,
)

STRESS_LABEL = "CASE WHEN x_1 > 0.5 THEN 0 WHEN x_2 + x_3 > 1.0 THEN 1 ELSE 2 END"
FEATURES = ["x_1", "x_2", "x_3"]
K = 3
SEED = 42


@dataclass(frozen=True)
class LinearSoftmax:
    """softmax(b + W x) as a column expression."""

    name: str
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    def attach(self, df: DataFrame, features: list[str], column: str) -> DataFrame:
        classes = range(len(self.intercepts))
        logits = [
            " + ".join([f"{b!r}D", *[f"{w!r}D * `{f}`" for w, f in zip(row, features)]])
            for b, row in zip(self.intercepts, self.weights)
        ]
        kept = [f"`{c}`" for c in df.columns]
        z = [f"{column}_z{c}" for c in classes]
        e = [f"{column}_e{c}" for c in classes]
        return (
            df.selectExpr(*kept, *[f"{x} AS {n}" for x, n in zip(logits, z)])
            .selectExpr("*", f"greatest({', '.join(z)}) AS {column}_top")
            .selectExpr(*kept, *[f"exp({n} - {column}_top) AS {m}" for n, m in zip(z, e)])
            .selectExpr("*", f"{' + '.join(e)} AS {column}_sum")
            .selectExpr(*kept, f"array({', '.join(f'{n} / {column}_sum' for n in e)}) AS {column}")
        )


SCORERS = [
    LinearSoftmax(
        "fix_a", (0.2173, -0.1137, 0.0311), ((2.0319, -1.0477, 0.5093), (-1.5221, 1.0139, 0.3067), (0.4057, 0.2011, -1.2203))
    ),
    LinearSoftmax(
        "fix_b", (0.5119, 0.1043, -0.4271), ((6.0731, -3.0419, 1.0237), (-5.0113, 4.0549, 2.0333), (1.5197, -0.5171, -3.0217))
    ),
    LinearSoftmax(
        "fix_c", (-0.1091, 0.0173, 0.1259), ((0.6137, -0.4219, 0.9043), (-0.8171, 0.5261, -0.2087), (0.3323, -0.6029, 0.1147))
    ),
]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    draw = keyed.uniform(keyed.digest(SEED, "fixture", "split", F.col("o_orderkey")), 0)
    return o.withColumn("u", draw).selectExpr(
        "o_orderkey AS row_id",
        "CASE WHEN u < 0.2D THEN 'test' WHEN u < 0.3D THEN 'validation' ELSE 'train' END AS split",
        "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y",
        "o_totalprice / 500000.0D AS x_1",
        "(cast(substring(o_orderpriority, 1, 1) AS int) - 1) / 4.0D AS x_2",
        "month(o_orderdate) / 12.0D AS x_3",
    )


_STORED: dict[tuple, StoredTable] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, by: list[str], rows) -> DataFrame:
    """The table of that name, made once per session and input and then read by every query that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        made = rows()
        path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _STORED[key] = StoredTable(spark, path, made.schema, by).put(made)
    return _STORED[key].read()


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(SCORERS, features(spark, sf_dir), FEATURES)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored predictions of the scorers, by model."""
    return _stored(spark, sf_dir, "predictions", ["model"], lambda: scored(spark, sf_dir))


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored results of the default suite, by model and test."""
    return _stored(spark, sf_dir, "stress_results", ["model", "test_name"], lambda: stress_results(spark, sf_dir))


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one evaluation set for the stress suite.

    Order status is unrelated to the features, so here the label is a rule on them: the scorers
    get much of it right and lose accuracy when the features are disturbed.
    The suite multiplies rows, so they are spread over the shuffle partitions first.
    """
    rows = features(spark, sf_dir).withColumn("split", F.lit("test")).withColumn("y", F.expr(STRESS_LABEL))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id")


def stress_results(spark: SparkSession, sf_dir: str, tests=stress.DEFAULT_SUITE) -> DataFrame:
    return stress.run(SCORERS, evaluation_rows(spark, sf_dir), FEATURES, tests, seed=SEED)


def models(spark: SparkSession) -> DataFrame:
    """Trained models: the scorers and one that was never evaluated."""
    schema = T.StructType([T.StructField("model", T.StringType()), T.StructField("model_seq", T.IntegerType())])
    names = [s.name for s in SCORERS] + [UNEVALUATED]
    return small_frame(spark, [(n, i) for i, n in enumerate(names)], schema)


UNEVALUATED = "fix_d"


# SQL side -----------------------------------------------------------------------------------

SQL_FEATURES = f"""feat AS (
  SELECT row_id, CASE WHEN u < 0.2::DOUBLE THEN 'test' WHEN u < 0.3::DOUBLE THEN 'validation' ELSE 'train' END AS split,
         y, x_1, x_2, x_3
  FROM (SELECT o_orderkey AS row_id,
               {uniform(digest(SEED, "'fixture'", "'split'", "o_orderkey"), 0)} AS u,
               CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
               o_totalprice / 500000.0::DOUBLE AS x_1,
               (substr(o_orderpriority, 1, 1)::INTEGER - 1)::DOUBLE / 4.0::DOUBLE AS x_2,
               month(o_orderdate)::DOUBLE / 12.0::DOUBLE AS x_3
        FROM orders))"""

_COEF_NAMES = [n for c in range(K) for n in (f"b{c}", *[f"w{c}{j}" for j in range(len(FEATURES))])]


def _models_sql() -> str:
    rows = []
    for i, s in enumerate(SCORERS):
        coefs = [v for b, row in zip(s.intercepts, s.weights) for v in (b, *row)]
        rows.append(f"({text(s.name)}, {i}, " + ", ".join(num(v) for v in coefs) + ")")
    return f"models(model, model_seq, {', '.join(_COEF_NAMES)}) AS (VALUES {', '.join(rows)})"


SQL_MODELS = _models_sql()


def logits_sql(cols=FEATURES, tag: str = "z") -> str:
    return ", ".join(
        f"b{c}" + "".join(f" + w{c}{j} * {col}" for j, col in enumerate(cols)) + f" AS {tag}{c}" for c in range(K)
    )


def argmax_sql(p: str = "p") -> str:
    return f"CASE WHEN {p}0 >= {p}1 AND {p}0 >= {p}2 THEN 0 WHEN {p}1 >= {p}2 THEN 1 ELSE 2 END"


SQL_PREDICTIONS = f"""{SQL_FEATURES}, {SQL_MODELS},
fix_z AS (SELECT model, model_seq, split, row_id, y AS y_true, {logits_sql()} FROM feat CROSS JOIN models),
fix_e AS (SELECT model, model_seq, split, row_id, y_true,
  {", ".join(f"exp(z{c} - greatest(z0, z1, z2)) AS e{c}" for c in range(K))} FROM fix_z),
fix_p AS (SELECT model, model_seq, split, row_id, y_true,
  {", ".join(f"e{c} / (e0 + e1 + e2) AS p{c}" for c in range(K))} FROM fix_e),
pred AS (SELECT *, greatest(p0, p1, p2) AS confidence, {argmax_sql()} AS y_pred FROM fix_p)"""


def with_predictions(body: str) -> str:
    return f"WITH {SQL_PREDICTIONS} {body}"


ENTROPY_SQL = "-(" + " + ".join(
    f"least(greatest(p{c}, 1e-10::DOUBLE), 1.0::DOUBLE) * ln(least(greatest(p{c}, 1e-10::DOUBLE), 1.0::DOUBLE))"
    for c in range(K)
) + ")"


def brier_sql(p: str = "p", y: str = "y_true") -> str:
    def gap(c: int) -> str:
        return f"({p}{c} - CASE WHEN {y} = {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"

    return "(" + " + ".join(f"{gap(c)} * {gap(c)}" for c in range(K)) + ")"


def confusion_metrics_sql(source: str, keys: str, pred: str = "y_pred", name: str = "cm") -> str:
    """CTEs ending in ``<name>_metrics``(keys, accuracy, precision, recall, f1)."""
    return f"""{name}_counts AS (SELECT {keys}, y_true, {pred} AS y_hat, count(*) AS n FROM {source} GROUP BY ALL),
{name}_labels AS (
  SELECT {keys}, label, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits
  FROM (SELECT {keys}, y_true AS label, n AS support, 0 AS predicted,
               CASE WHEN y_true = y_hat THEN n ELSE 0 END AS hits FROM {name}_counts
        UNION ALL
        SELECT {keys}, y_hat, 0, n, 0 FROM {name}_counts)
  GROUP BY ALL),
{name}_classes AS (
  SELECT {keys}, label, support, hits,
         CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0e0 END AS precision,
         CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0e0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2e0 * hits / (support + predicted) ELSE 0e0 END AS f1
  FROM {name}_labels),
{name}_metrics AS (
  SELECT {keys}, sum(hits)::DOUBLE / sum(support) AS accuracy,
         sum(support * precision) / sum(support) AS precision,
         sum(support * recall) / sum(support) AS recall,
         sum(support * f1) / sum(support) AS f1
  FROM {name}_classes GROUP BY {keys})"""


_MAPS = [f"c{r}{i}" for r in range(keyed.WORDS) for i in range(keyed.WORDS)]


def _tests_sql(tests) -> str:
    rows = []
    for i, t in enumerate(tests):
        factors = [
            stress.coin_factor(t, f, SEED) if t.type == "scale_perturbation" else 1.0 for f in FEATURES
        ]
        maps = [c for coefs in stress.test_coefficients(t, SEED) for c in coefs]
        rows.append(
            f"({i}, {text(t.title)}, {text(stress.flavour(t))}, {num(stress.amount(t))}, "
            + ", ".join(num(v) for v in factors)
            + ", "
            + ", ".join(str(c) for c in maps)
            + ")"
        )
    return f"tests(test_seq, test_name, kind, amount, f1, f2, f3, {', '.join(_MAPS)}) AS (VALUES {', '.join(rows)})"


def stressed_features_sql(tests=stress.DEFAULT_SUITE) -> str:
    """CTEs ending in ``stressed``(row_id, y, x_1.., test_seq, test_name, s1, s2, s3)."""
    stats = ", ".join(
        f"avg({f}) AS m{j}, stddev_pop({f}) AS sd{j}, min({f}) AS lo{j}, max({f}) AS hi{j}"
        for j, f in enumerate(FEATURES, 1)
    )
    own = ", ".join(
        mix_sql([f"w{i}" for i in range(keyed.WORDS)], [f"c{r}{i}" for i in range(keyed.WORDS)]) + f" AS t{r}"
        for r in range(keyed.WORDS)
    )
    terms = [f"t{i}" for i in range(keyed.WORDS)]
    cells = [(j, f, slot) for j, f in enumerate(FEATURES, 1) for slot in range(3)]
    lines = ", ".join(f"{line_sql(terms, f, slot)} AS g{j}_{slot}" for j, f, slot in cells)
    bends = ", ".join(f"{bent_sql(f'g{j}_{slot}')} AS h{j}_{slot}" for j, _, slot in cells)
    ranks = ", ".join(
        f"row_number() OVER (PARTITION BY test_seq ORDER BY {fine_uniform_sql(f'h{j}_0', f'h{j}_1')}, row_id) AS r{j}"
        for j, f in enumerate(FEATURES, 1)
    )

    def formula(j: int, x: str) -> str:
        pick = f"r{j} <= floor(n * amount)"
        u, v, w = (open_uniform_sql(f"h{j}_{slot}") for slot in range(3))
        o = fine_uniform_sql(f"h{j}_0", f"h{j}_1")
        pi2 = "6.283185307179586::DOUBLE"
        return f"""CASE kind
  WHEN 'gaussian_noise' THEN {x} + sqrt(-2.0::DOUBLE * ln({u})) * cos({pi2} * {v}) * (sd{j} * amount)
  WHEN 'uniform_noise' THEN {x} + ({u} * 2.0::DOUBLE - 1.0::DOUBLE) * ((hi{j} - lo{j}) * amount)
  WHEN 'feature_dropout' THEN CASE WHEN {o} > amount THEN {x} ELSE 0e0 END
  WHEN 'corrupt_zero' THEN CASE WHEN {pick} THEN 0e0 ELSE {x} END
  WHEN 'corrupt_mean' THEN CASE WHEN {pick} THEN m{j} ELSE {x} END
  WHEN 'corrupt_random' THEN CASE WHEN {pick} THEN lo{j} + (hi{j} - lo{j}) * {w} ELSE {x} END
  WHEN 'corrupt_extreme' THEN CASE WHEN {pick} THEN CASE WHEN {w} < 0.5::DOUBLE THEN lo{j} ELSE hi{j} END ELSE {x} END
  WHEN 'scale_perturbation' THEN {x} * f{j}
  WHEN 'shift_mean' THEN {x} + sd{j} * amount
  WHEN 'shift_variance' THEN m{j} + ({x} - m{j}) * amount END AS s{j}"""

    cols = ", ".join(formula(j, f) for j, f in enumerate(FEATURES, 1))
    return f"""{_tests_sql(tests)},
stats AS (SELECT count(*) AS n, {stats} FROM feat),
worded AS (SELECT *, {words_sql(SEED, 'row_id')} FROM feat),
drawn AS (SELECT worded.*, tests.*, {own} FROM worded CROSS JOIN tests),
lined AS (SELECT *, {lines} FROM drawn),
bent AS (SELECT *, {bends} FROM lined),
ranked AS (SELECT *, {ranks} FROM bent),
stressed AS (SELECT row_id, {STRESS_LABEL} AS y, x_1, x_2, x_3, test_seq, test_name, {cols} FROM ranked CROSS JOIN stats)"""


def stress_results_ctes(tests=stress.DEFAULT_SUITE, base: bool = True) -> str:
    """CTEs ending in ``stress_results``; every row of ``orders`` is scored before and after.

    ``base`` is off where the feature and model CTEs are already there.
    """
    first = f"{SQL_FEATURES}, {SQL_MODELS}, " if base else ""
    return f"""{first}{stressed_features_sql(tests)},
st_z AS (SELECT model, model_seq, test_seq, test_name, row_id, y AS y_true, {logits_sql(FEATURES, 'z')},
         {logits_sql(['s1', 's2', 's3'], 'q')} FROM stressed CROSS JOIN models),
st_e AS (SELECT *, {', '.join(f'exp({z}{c} - greatest({z}0, {z}1, {z}2)) AS {z}e{c}' for z in 'zq' for c in range(K))} FROM st_z),
st_p AS (SELECT *, {', '.join(f'{z}e{c} / ({z}e0 + {z}e1 + {z}e2) AS {z}p{c}' for z in 'zq' for c in range(K))} FROM st_e),
st_pred AS (SELECT model, model_seq, 'test' AS split, test_seq, test_name, row_id, y_true,
         {argmax_sql('zp')} AS y_before, {argmax_sql('qp')} AS y_after FROM st_p),
{confusion_metrics_sql('st_pred', 'model, model_seq, split, test_seq, test_name', 'y_after', 'st')},
st_base AS (SELECT model, test_seq, avg(CASE WHEN y_before = y_true THEN 1e0 ELSE 0e0 END) AS accuracy_original,
         avg(CASE WHEN y_before = y_after THEN 1e0 ELSE 0e0 END) AS prediction_agreement
         FROM st_pred GROUP BY model, test_seq),
stress_results AS (SELECT m.model, m.model_seq, m.split, m.test_seq, m.test_name, b.accuracy_original,
         m.accuracy AS accuracy_stressed, b.accuracy_original - m.accuracy AS performance_drop,
         CASE WHEN b.accuracy_original > 0 THEN (b.accuracy_original - m.accuracy) / b.accuracy_original * 100e0
              ELSE 0e0 END AS performance_drop_pct,
         m.precision AS precision_stressed, m.recall AS recall_stressed, m.f1 AS f1_stressed, b.prediction_agreement
         FROM st_metrics m JOIN st_base b ON m.model = b.model AND m.test_seq = b.test_seq)"""


SQL_TRAINED = "trained(model, model_seq) AS (VALUES " + ", ".join(
    f"({text(n)}, {i})" for i, n in enumerate([*[s.name for s in SCORERS], UNEVALUATED])
) + ")"

"""Training and scoring queries. SQL cannot fit a model, so it checks what must hold of any: sizes, sums, equal copies."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import compiled, evaluate, features, models, reliability, scoring, stress
from plumbline.plans import scorecard
from plumbline.session import held, shared_folder
from plumbline.sources.artifacts import artifact_path

from . import fixtures as fx
from .base import query, table, tidy

WIDTH = 64
COLUMNS = [f"e_{i}" for i in range(WIDTH)]


def rows(spark, sf):
    """Every embedding with its label, split exactly and stratified only below ten classes."""
    wide = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").alias("y"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COLUMNS)],
    )
    return features.split(wide, "y", "row_id", seed=fx.SEED)


def binary(spark, sf):
    return rows(spark, sf).withColumn("y", (F.col("y") >= 5).cast("int"))


def train_rows(df):
    return df.filter(F.col("split") == features.TRAIN)


def metric_rows(model, df):
    table_ = evaluate.metrics(models.score([model], df), ("model", "model_seq", "split"))
    return tidy(table_.select("model", "split", *evaluate.METRICS))


@query("m1_logistic_regression")
def m1(spark, sf):
    df = rows(spark, sf)
    return metric_rows(models.fit(models.LOGISTIC, train_rows(df), COLUMNS), df)


@query("m2_random_forest")
def m2(spark, sf):
    df = rows(spark, sf)
    return metric_rows(models.fit(models.FOREST, train_rows(df), COLUMNS), df)


@query("m3_boosted_trees")
def m3(spark, sf):
    df = binary(spark, sf)
    return metric_rows(models.fit(models.BOOSTED, train_rows(df), COLUMNS), df)


@query("m4_predict")
def m4(spark, sf):
    df = rows(spark, sf)
    pred = models.score([models.fit(models.LOGISTIC, train_rows(df), COLUMNS)], df)
    return tidy(pred.select("row_id", "split", "y_true", "y_pred", F.array_max("proba").alias("confidence")))


@query(
    "m4_predictions_by_arrays",
    """SELECT kind AS model, vec_id AS row_id, true AS same_label, true AS same_probabilities
    FROM embeddings CROSS JOIN (SELECT unnest(['Logistic Regression', 'Random Forest']) AS kind)""",
)
def m4_arrays(spark, sf):
    """Every row's label and probabilities from the pipeline against those from the models' own arrays and nodes."""
    df = rows(spark, sf)
    fitted = [models.fit(kind, train_rows(df), COLUMNS) for kind in (models.LOGISTIC, models.FOREST)]
    key = ["model", "row_id"]
    one = models.score(fitted, df).select(*key, F.col("y_pred").alias("a"), F.col("proba").alias("p"))
    other = scoring.score([compiled.Compiled(spark, m) for m in fitted], df, COLUMNS)
    both = one.join(other.select(*key, F.col("y_pred").alias("b"), F.col("proba").alias("q")), key)
    gap = F.aggregate(F.zip_with("p", "q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)
    return both.select(*key, (F.col("a") == F.col("b")).alias("same_label"), (gap < 1e-9).alias("same_probabilities"))


@query(
    "m13_top_features_by_nodes",
    """SELECT unnest(range(1, 11))::BIGINT AS place, true AS same_feature, true AS same_importance, 10::BIGINT AS shown
    FROM (SELECT count(*) AS n FROM embeddings) WHERE n > 0""",
)
def m13_nodes(spark, sf):
    """The ten features that weigh most, against those recomputed from the gains of the forest's nodes."""
    model = models.fit(models.FOREST, train_rows(rows(spark, sf)), COLUMNS)
    found = compiled.importances(compiled.node_table(spark, model), COLUMNS, per_tree=True)
    told = models.importance_frame(spark, model, 10)
    order = Window.orderBy(F.desc(F.round("importance", 12)), "feature")
    ranked = [t.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 10") for t in (told, found)]
    pairs = ranked[0].toDF("f", "x", "place").join(ranked[1].toDF("g", "y", "place"), "place")
    same = [(F.col("f") == F.col("g")).alias("same_feature"), (F.abs(F.col("x") - F.col("y")) < 1e-9).alias("same_importance")]
    return pairs.select("place", *same, F.count("*").over(Window.partitionBy()).alias("shown"))


@query("m12_feature_importance")
def m12(spark, sf):
    model = models.fit(models.FOREST, train_rows(rows(spark, sf)), COLUMNS)
    return tidy(models.importance_frame(spark, model))


@query("m13_top_features")
def m13(spark, sf):
    model = models.fit(models.FOREST, train_rows(rows(spark, sf)), COLUMNS)
    return tidy(models.importance_frame(spark, model, 10))


def soundness(model, df):
    """How many rows are scored, have probabilities that sum to 1, and bear the label of the largest one."""
    pred = models.score([model], df)
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    first = F.array_position("proba", F.array_max("proba")) - 1
    counts = {"rows": F.lit(True), "sums": F.abs(total - 1) < 1e-6, "labels": F.col("y_pred") == first, "known": F.col("y_true").isNotNull()}
    return pred.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()])


SOUND = "SELECT count(*) AS rows, count(*) AS sums, count(*) AS labels, count(*) AS known FROM embeddings"


@query("m1_logistic_soundness", SOUND)
def m1_sound(spark, sf):
    df = rows(spark, sf)
    return soundness(models.fit(models.LOGISTIC, train_rows(df), COLUMNS), df)


@query("m2_forest_soundness", SOUND)
def m2_sound(spark, sf):
    df = rows(spark, sf)
    return soundness(models.fit(models.FOREST, train_rows(df), COLUMNS), df)


@query("m3_boosting_by_class_soundness", SOUND)
def m3_sound(spark, sf):
    """Boosting at its default size with a model for each of the ten classes."""
    df = rows(spark, sf)
    return soundness(models.fit(models.BOOSTED, train_rows(df), COLUMNS), df)


@query("m12_importance_soundness", "SELECT max(len(embedding))::BIGINT AS features, 1e0 AS total, 0::BIGINT AS negative FROM embeddings")
def m12_sound(spark, sf):
    found = models.importance_frame(spark, models.fit(models.FOREST, train_rows(rows(spark, sf)), COLUMNS))
    return tidy(found.agg(F.count("*").alias("features"), F.sum("importance").alias("total"), F.count(F.when(F.col("importance") < 0, 1)).alias("negative")))


@query("s3_reloaded_predictions", "SELECT vec_id AS row_id, true AS same FROM embeddings")
def s3_same(spark, sf):
    """A loaded model predicts what the saved one did."""
    df = rows(spark, sf)
    book = models.ModelBook()
    book.train(models.LOGISTIC, train_rows(df), COLUMNS)
    path = artifact_path(f"{shared_folder(spark)}/{uuid.uuid4().hex}", models.LOGISTIC)
    book.save(models.LOGISTIC, path)
    loaded = models.ModelBook()
    loaded.load(models.LOGISTIC, path)
    before, after = (b.predict(models.LOGISTIC, df).select("row_id", "y_pred", "proba") for b in (book, loaded))
    gap = F.aggregate(F.zip_with("p", "q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)
    both = before.toDF("row_id", "a", "p").join(after.toDF("row_id", "b", "q"), "row_id")
    return both.select("row_id", ((F.col("a") == F.col("b")) & (gap < 1e-9)).alias("same"))


@query("s3_save_and_load_model")
def s3(spark, sf):
    """Save, load and evaluate on the three splits."""
    df = rows(spark, sf)
    book = models.ModelBook()
    book.train(models.LOGISTIC, train_rows(df), COLUMNS)
    path = artifact_path(f"{shared_folder(spark)}/{uuid.uuid4().hex}", models.LOGISTIC)
    book.save(models.LOGISTIC, path)
    loaded = models.ModelBook()
    loaded.load("Loaded Model", path)
    return tidy(loaded.evaluate(df).select("model", "split", *evaluate.METRICS))


@query(
    "r5_trained_model",
    """SELECT 'Logistic Regression' AS model, 'Performance, Calibration, Robustness, Confidence' AS evidence, true AS sums, true AS bounded, 19::BIGINT AS tests
    WHERE (SELECT count(*) FROM embeddings) > 0""",
)
def r5_trained(spark, sf):
    """Train, predict, stress the test split on all 64 features and grade: one model end to end."""
    df = rows(spark, sf)
    model = models.fit(models.LOGISTIC, train_rows(df), COLUMNS)
    damage = held(stress.run([model], df.filter(F.col("split") == features.TEST), COLUMNS, seed=fx.SEED))
    named = spark.createDataFrame([(model.name, 0)], "model string, model_seq int")
    card = scorecard.scorecard(named, models.score([model], df), damage)
    parts = [F.col(c.lower()) for c in reliability.COMPONENTS]
    tests = damage.groupBy("model").agg(F.count(F.lit(1)).alias("tests"))
    shown = card.select(
        "model",
        F.array_join("available_components", ", ").alias("evidence"),
        (F.abs(sum(parts[1:], parts[0]) - F.col("total")) < 0.01).alias("sums"),
        reduce(and_, [c.between(0, 30) for c in parts]).alias("bounded"),
    )
    return shown.join(tests, "model")

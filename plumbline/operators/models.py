"""Training and scoring with Spark ML classifiers behind the names users know.

A trained model is one ``PipelineModel``: a vector assembler and one or more classifiers. It
scores by adding a probability array, so it plugs into batch scoring and stress tests.
Forests are Spark ML's, but grown and kept by ``forest``, whose cost goes with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import held
from . import evaluate, forest, scoring

LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "XGBoost"
KINDS = (LOGISTIC, FOREST, BOOSTED)

# Deepest tree Spark ML accepts; stands for the unlimited depth of an unset ``max_depth``.
DEEPEST = 30

_FEATURES = "__features"

# Classifiers of one model that are fitted at the same time.
SIDE_BY_SIDE = 16


@dataclass(frozen=True)
class TrainedModel:
    name: str
    pipeline: PipelineModel

    @property
    def features(self) -> list[str]:
        return self.pipeline.stages[0].getInputCols()

    @property
    def classifiers(self) -> list:
        return self.pipeline.stages[1:]

    def attach(self, df: DataFrame, features: Sequence[str], column: str) -> DataFrame:
        """Add the class probabilities; nothing else of the pipeline's output stays."""
        if list(features) != self.features:
            raise ValueError(f"{self.name} was trained on {self.features}")
        if isinstance(self.classifiers[0], forest.Forest):
            return self.classifiers[0].attach(df, features, column)
        scored = self.pipeline.transform(df)
        arrays = [vector_to_array(F.col(c.getProbabilityCol())) for c in self.classifiers]
        if len(arrays) == 1:
            return scored.select(*df.columns, arrays[0].alias(column))
        positive = [F.get(a, F.lit(1)) for a in arrays]
        named = scored.select(*df.columns, *[p.alias(f"__pos_{i}") for i, p in enumerate(positive)])
        cols = [F.col(f"__pos_{i}") for i in range(len(positive))]
        total = reduce(add, cols)
        even = F.lit(1.0 / len(cols))
        shares = F.array(*[F.when(total > 0, c / total).otherwise(even) for c in cols])
        return named.select(*df.columns, shares.alias(column))

    def importance(self) -> list[tuple[str, float]] | None:
        """(feature, importance) pairs; None for models without importances."""
        if isinstance(self.classifiers[0], forest.Forest):
            return list(zip(self.features, self.classifiers[0].importances().tolist()))
        if not all(
            isinstance(c, (RandomForestClassificationModel, GBTClassificationModel)) for c in self.classifiers
        ):
            return None
        each = [c.featureImportances.toArray() for c in self.classifiers]
        mean = sum(each) / len(each)
        return [(f, float(v)) for f, v in zip(self.features, mean)]


def estimators(kind: str, rows: int, n_classes: int, target: str, **params) -> list:
    """Spark ML's classifiers behind a kind: one, or one per class for boosting with three or more classes."""
    seed = params.get("random_state", 42)
    if kind == LOGISTIC:
        # mean loss + regParam / 2 * |w|^2 equals the sum form C * loss + |w|^2 / 2 divided by C * rows
        return [
            LogisticRegression(
                featuresCol=_FEATURES,
                labelCol=target,
                regParam=1.0 / (params.get("C", 1.0) * max(rows, 1)),
                elasticNetParam=0.0,
                maxIter=params.get("max_iter", 1000),
                standardization=False,
            )
        ]
    if kind == BOOSTED:
        targets = [target] if n_classes <= 2 else [f"__is_{c}" for c in range(n_classes)]
        return [
            GBTClassifier(
                featuresCol=_FEATURES,
                labelCol=t,
                maxIter=params.get("n_estimators", 100),
                maxDepth=params.get("max_depth", 6),
                stepSize=params.get("learning_rate", 0.1),
                seed=seed,
            )
            for t in targets
        ]
    raise ValueError(f"Unknown model: {kind}")


def grown(df: DataFrame, features: Sequence[str], target: str, rows: int, n_classes: int, **params) -> forest.Forest:
    depth = params.get("max_depth")
    if depth is not None and depth > DEEPEST:
        raise ValueError(f"max_depth must be at most {DEEPEST}, or None for no limit")
    if params.get("min_samples_split", 2) != 2:
        # Spark limits the rows of a child, not of the node that is split
        raise ValueError("min_samples_split other than 2 is not supported; use min_samples_leaf")
    return forest.fit(
        df,
        features,
        target,
        rows,
        n_classes,
        n_trees=params.get("n_estimators", 100),
        depth=DEEPEST if depth is None else depth,
        least=params.get("min_samples_leaf", 1),
        seed=params.get("random_state", 42),
    )


def fit(
    kind: str, df: DataFrame, features: Sequence[str], target: str = "y", name: str | None = None, **params
) -> TrainedModel:
    """Fit one kind on the rows of ``df``. Labels must be 0..k-1."""
    if kind not in KINDS:
        raise ValueError(f"Unknown model: {kind}")
    assembler = VectorAssembler(inputCols=list(features), outputCol=_FEATURES)
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.max(target).alias("top")).first()
    if not shape["n"]:
        raise ValueError("no rows to train on")
    n_classes = int(shape["top"]) + 1
    if kind == FOREST:
        return TrainedModel(name or kind, PipelineModel([assembler, grown(df, features, target, shape["n"], n_classes, **params)]))
    rows = assembler.transform(df.select(*features, F.col(target).cast("double").alias(target)))
    chosen = estimators(kind, shape["n"], n_classes, target, **params)
    one_vs_rest = len(chosen) > 1
    if one_vs_rest:
        rows = rows.select(
            "*", *[(F.col(target) == c).cast("double").alias(f"__is_{c}") for c in range(n_classes)]
        )
    tags = [f"__{i}" for i in range(len(chosen))] if one_vs_rest else [""]
    named = [
        e.setPredictionCol(f"__prediction{tag}").setRawPredictionCol(f"__raw{tag}").setProbabilityCol(f"__probability{tag}")
        for e, tag in zip(chosen, tags)
    ]
    if not one_vs_rest:
        return TrainedModel(name or kind, PipelineModel([assembler, named[0].fit(rows)]))
    # the classes are fitted side by side on one kept feature matrix: a boosting round alone is too little work for a cluster
    kept = held(rows)
    try:
        with ThreadPool(min(len(named), SIDE_BY_SIDE)) as pool:
            fitted = pool.map(inheritable_thread_target(df.sparkSession)(lambda e: e.fit(kept)), named, chunksize=1)
    finally:
        kept.unpersist()
    return TrainedModel(name or kind, PipelineModel([assembler, *fitted]))


def score(models: Sequence[TrainedModel], df: DataFrame, key: str = "row_id", target: str = "y") -> DataFrame:
    """predictions of all models over a frame with a ``split`` column, in one scan."""
    return scoring.score(models, df, models[0].features, key, target)


def importance_frame(spark: SparkSession, model: TrainedModel, top: int | None = None) -> DataFrame | None:
    """(feature, importance), largest first; None for a model without importances."""
    pairs = model.importance()
    if pairs is None:
        return None
    table = spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
    return table if top is None else table.limit(top)


class ModelBook:
    """Trained models by name, in training order."""

    def __init__(self) -> None:
        self.models: dict[str, TrainedModel] = {}

    def train(self, kind: str, df: DataFrame, features: Sequence[str], target: str = "y", **params) -> TrainedModel:
        self.models[kind] = fit(kind, df, features, target, **params)
        return self.models[kind]

    def get(self, name: str) -> TrainedModel:
        if name not in self.models:
            raise ValueError(f"Model {name} not trained yet")
        return self.models[name]

    def predict(self, name: str, df: DataFrame, key: str = "row_id", target: str = "y") -> DataFrame:
        return score([self.get(name)], df, key, target)

    def evaluate(self, df: DataFrame, key: str = "row_id", target: str = "y") -> DataFrame:
        """Metrics of every model on every split of ``df``."""
        pred = score(list(self.models.values()), df, key, target)
        return evaluate.metrics(pred, ("model", "model_seq", "split"))

    def save(self, name: str, path: str) -> None:
        self.get(name).pipeline.write().overwrite().save(path)

    def load(self, name: str, path: str) -> TrainedModel:
        self.models[name] = TrainedModel(name, PipelineModel.load(path))
        return self.models[name]

"""Fitted models taken apart: node tables, and a second way of scoring that doesn't run the pipeline.

A tree ensemble becomes a table with a row per node, from which importances are recomputed by aggregates; any model becomes a few
arrays that score Arrow batches, whole batches at a time. Both check what Spark ML says of a model, and the arrays need no Spark ML
on the way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder, ship
from .forest import Forest
from .models import TrainedModel

NODES = ["classifier", "tree", "node", "feature", "threshold", "left", "right", "prediction", "stats", "gain"]


def node_table(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """(classifier, tree, node, feature, threshold, left, right, prediction, stats, gain) of a tree ensemble.

    A leaf has no children (-1). ``stats`` are the weighted class counts of a forest's node; of a boosted tree's node they
    begin with its weighted count. Spark ML's models are read as Spark saves them, in the folder of ``spark.checkpoint.dir``.
    """
    parts = []
    for i, classifier in enumerate(model.classifiers):
        if isinstance(classifier, Forest):
            node = classifier.node_table(spark).select("treeID", "nodeData.*")
        elif isinstance(classifier, (RandomForestClassificationModel, GBTClassificationModel)):
            path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
            classifier.write().save(path)
            node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
        else:
            raise ValueError(f"{model.name} has no trees")
        parts.append(
            node.select(
                F.lit(i).alias("classifier"),
                F.col("treeID").alias("tree"),
                F.col("id").alias("node"),
                F.col("split.featureIndex").alias("feature"),
                F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
                F.col("leftChild").alias("left"),
                F.col("rightChild").alias("right"),
                "prediction",
                F.col("impurityStats").alias("stats"),
                "gain",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def importances(nodes: DataFrame, features: Sequence[str], per_tree: bool) -> DataFrame:
    """(feature, importance): gains weighted by the rows of their nodes, as shares; 0 for a feature that splits nothing.

    ``per_tree`` gives every tree the same weight (forests); otherwise a classifier's trees are added up as they are (boosting).
    Several classifiers count alike.
    """
    rows = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x) if per_tree else F.get("stats", F.lit(0))
    gains = nodes.where("left >= 0").select("classifier", "tree", "feature", (F.col("gain") * rows).alias("gain"))
    by_tree = gains.groupBy("classifier", "tree", "feature").agg(F.sum("gain").alias("gain"))
    if per_tree:
        whole = by_tree.groupBy("classifier", "tree").agg(F.sum("gain").alias("whole"))
        by_tree = by_tree.join(whole, ["classifier", "tree"]).select("classifier", "feature", (F.col("gain") / F.col("whole")).alias("gain"))
    by_classifier = by_tree.groupBy("classifier", "feature").agg(F.sum("gain").alias("gain"))
    total = by_classifier.groupBy("classifier").agg(F.sum("gain").alias("total"))
    n = nodes.agg(F.count_distinct("classifier")).first()[0]
    shares = by_classifier.join(total, "classifier").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("sum"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "at int, name string")
    found = names.join(shares, F.col("at") == F.col("feature"), "left")
    return found.select(F.col("name").alias("feature"), F.coalesce(F.col("sum") / n, F.lit(0.0)).alias("importance"))


class _Linear:
    def __init__(self, model: LogisticRegressionModel):
        self.weights = model.coefficientMatrix.toArray()
        self.intercepts = model.interceptVector.toArray()

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights.T + self.intercepts
        if margin.shape[1] == 1:
            margin = np.column_stack([np.zeros(len(x)), margin[:, 0]])
        odds = np.exp(margin - margin.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


PACKED = "classifier int, tree int, feature binary, threshold binary, left binary, right binary, rows binary"


def packed(nodes: DataFrame, boosted: bool) -> DataFrame:
    """A row for each tree, with its nodes as arrays; ``rows`` has the distinct leaf values, ``left`` of a leaf is the complement of its row."""
    names = [f.split()[0] for f in PACKED.split(", ")]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        feature, left, right = (table[c].to_numpy().astype(np.int32) for c in ("feature", "left", "right"))
        leaf = left < 0
        threshold = np.where(leaf, np.inf, table["threshold"].to_numpy()).astype(np.float64)
        if boosted:
            values = table["prediction"].to_numpy().astype(np.float64)[:, None]
        else:
            stats = table["stats"].combine_chunks().flatten().to_numpy().reshape(len(left), -1)
            values = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
        rows, row = np.unique(values[leaf], axis=0, return_inverse=True)
        left[leaf] = ~row.ravel()
        ids = [pa.array([table[c][0].as_py()], pa.int32()) for c in names[:2]]
        return pa.Table.from_arrays([*ids, *[pa.array([x.tobytes()], pa.binary()) for x in (feature, threshold, left, right, rows)]], names)

    return nodes.groupBy("classifier", "tree").applyInArrow(pack, PACKED)


class _Trees:
    """All trees of one classifier, each as arrays over its nodes."""

    def __init__(self, trees: list[dict], weights: Sequence[float], boosted: bool, classes: int):
        self.boosted, self.weights, self.classes = boosted, np.array(weights, np.float64), 1 if boosted else classes
        kinds = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "rows": np.float64}
        ordered = sorted(trees, key=lambda r: r["tree"])
        self.trees = [[np.frombuffer(r[c], kind) for c, kind in kinds.items()] for r in ordered]

    def values(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the values of the leaf that each row reaches."""
        for feature, threshold, left, right, rows in self.trees:
            at, going = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(going := going[left[at[going]] >= 0]):
                here = at[going]
                at[going] = np.where(x[going, feature[here]] <= threshold[here], left[here], right[here])
            yield rows.reshape(-1, self.classes)[~left[at]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.boosted:
            margin = sum((found[:, 0] * w for found, w in zip(self.values(x), self.weights)), np.zeros(len(x)))
            positive = 1.0 / (1.0 + np.exp(-2.0 * margin))
            return np.column_stack([1.0 - positive, positive])
        votes = sum(self.values(x), np.zeros((len(x), self.classes)))
        return votes / votes.sum(axis=1, keepdims=True)


def _probabilities(name: str, parts: list, x: np.ndarray) -> np.ndarray:
    if np.isnan(x).any():
        raise ValueError(f"{name}: features without values")
    each = [p.probabilities(x) for p in parts]
    if len(each) == 1:
        return each[0]
    positive = np.column_stack([e[:, 1] for e in each])
    total = positive.sum(axis=1, keepdims=True)
    return np.where(total > 0, positive / np.where(total > 0, total, 1.0), 1.0 / len(each))


class Compiled:
    """A scorer (``name``, ``attach``) made of the arrays of a fitted model. Null or NaN features are an error, as in the pipeline."""

    def __init__(self, spark: SparkSession, model: TrainedModel):
        self.name, self.features = model.name, list(model.features)
        self.parts: list = []
        if any(isinstance(c, LogisticRegressionModel) for c in model.classifiers):
            self.parts = [_Linear(c) for c in model.classifiers]
            return
        ship(spark)
        boosted = isinstance(model.classifiers[0], GBTClassificationModel)
        by_classifier: dict = {}
        rows = packed(node_table(spark, model), boosted).toArrow()  # the size of the model, which every task holds anyway
        for r in (r for b in rows.to_batches() for r in b.to_pylist()):
            by_classifier.setdefault(r["classifier"], []).append(r)
        for i, c in enumerate(model.classifiers):
            classes = c.classes if isinstance(c, Forest) else c.numClasses
            self.parts.append(_Trees(by_classifier[i], c.treeWeights, boosted, classes))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _probabilities(self.name, self.parts, x)

    def attach(self, df: DataFrame, features: Sequence[str], column: str) -> DataFrame:
        if list(features) != self.features:
            raise ValueError(f"{self.name} was trained on {self.features}")
        ship(df.sparkSession)
        model = df.sparkSession.sparkContext.broadcast((self.name, self.parts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features]).astype(np.float64)
                p = _probabilities(*model.value, x)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * p.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, column])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))]))

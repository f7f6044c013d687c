"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (columns a, b) is connected with.

    Every round takes the smallest label among a node and its neighbours, then the label of that label, so long chains
    shorten fast. Minima combine before they are shuffled: a node with very many neighbours is no single task's work.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    while True:
        step = written(_round(both, labels).withColumnRenamed("label", "before").withColumnRenamed("new", "label"))
        labels = step.select("node", "label")
        if step.where("before <> label").isEmpty():
            return labels


def _round(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, new)"""
    seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
    near = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
    lower = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), "label")
    jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
    return lower.join(jump, "low").select("node", "label", F.least("low", "lower").alias("new"))


def joined_classes(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, label), with the classes joined that ``links`` (a, b) connect; only their labels are gone through."""
    if labels is None:
        return components(links)
    la, lb = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    named = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(named.where("a <> b"))
    fresh = merged.select(F.col("node").alias("_old"), F.col("label").alias("_new"))
    known = labels.join(fresh, F.col("label") == F.col("_old"), "left").select("node", F.coalesce("_new", "label").alias("label"))
    first = merged.join(labels.select("node"), "node", "left_anti")  # documents without a class before
    return written(known.unionByName(first.select("node", "label")))

"""Random forests that Spark ML would grow, at a cost that goes with the rows.

Spark ML gives every open node statistics for all bins and classes, in every partition, and keeps all trees as objects on the
driver. Trees without a depth limit have about as many nodes as rows, most of them with a few rows. Here the rows are cut into bins
and drawn for the trees where they lie, and dealt to tasks that grow some of the trees each, level by level, looking only at the bins
that a node's rows are in. Draws, bins, splits, pruning and ties are those of Spark ML, so that one task for all trees makes the very
trees that Spark ML makes when a level fits its ``maxMemoryInMB``. Several tasks try other features at the nodes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import draws

#: Spark ML's ``maxBins``, and the rows that are sampled at least to find the bins. A sample that comes out large has a bin more.
BINS, SAMPLED = 32, 10_000

#: Cells (rows x trees) that one task grows, and the tasks that all rows are copied to at most.
TASK_CELLS, MOST_TASKS = 1 << 19, 32

#: Cells (rows x features tried) looked at at once: few enough for a core's cache.
STEP_CELLS = 1 << 15

_EPSILON = 2.0**-52

_TREE = "tree int, feature binary, bin binary, link binary, stats binary, importance binary"
_TREE_NAMES = [f.split()[0] for f in _TREE.split(", ")]

NODE = (
    "id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, "
    "rightChild int, split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
)


def gini(counts: Sequence[np.ndarray], total: np.ndarray) -> np.ndarray:
    """Class by class in order, so that equal gains come out equal as they do in Spark ML."""
    out = np.ones(len(total))
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in counts:
            share = c / total
            out -= share * share
    return np.where(total > 0, out, 0.0)


@dataclass(frozen=True)
class Tree:
    """Nodes in preorder: the left child comes next.

    ``link`` is the right child; of a leaf, whose ``feature`` is -1, it is the row of ``stats`` with its class counts.
    """

    feature: np.ndarray
    bin: np.ndarray
    link: np.ndarray
    stats: np.ndarray
    importance: np.ndarray

    def row(self, number: int) -> pa.RecordBatch:
        packed = [x.tobytes() for x in (self.feature, self.bin, self.link, self.stats, self.importance)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *[pa.array([b], pa.binary()) for b in packed]], _TREE_NAMES)

    @classmethod
    def unpacked(cls, row, classes: int) -> Tree:
        kinds = (("feature", np.int32), ("bin", np.uint8), ("link", np.int32), ("stats", np.int64), ("importance", np.float64))
        each = [np.frombuffer(row[name], kind) for name, kind in kinds]
        each[3] = each[3].reshape(-1, classes)
        return cls(*each)

    @cached_property
    def shares(self) -> np.ndarray:
        """The class shares of each row of ``stats``; zeros for a leaf without rows."""
        total = self.stats.sum(axis=1, keepdims=True)
        return np.where(total > 0, self.stats / np.maximum(total, 1), 0.0)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Class shares of the leaf that each row of bins reaches."""
        at, going = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(going := going[self.feature[at[going]] >= 0]):
            here = at[going]
            left = x[going, self.feature[here]] <= self.bin[here]
            at[going] = np.where(left, here + 1, self.link[here])
        return self.shares[self.link[at]]

    def nodes(self, thresholds: Sequence[np.ndarray], tree: int) -> pa.RecordBatch:
        """(treeID, nodeData) as Spark ML saves them, but that it gives leaves that it couldn't split an impurity of -1."""
        n, k = len(self.feature), self.stats.shape[1]
        leaf = self.feature < 0
        counts = np.zeros((n, k))
        counts[leaf] = self.stats[self.link[leaf]]
        left, right = np.where(leaf, -1, np.arange(n) + 1), np.where(leaf, -1, self.link)
        for i in np.flatnonzero(~leaf)[::-1]:  # children come after their parents
            counts[i] = counts[i + 1] + counts[right[i]]
        total = counts.sum(axis=1)
        impurity = gini(counts.T, total)
        gain = np.full(n, -1.0)
        inner = np.flatnonzero(~leaf)
        a, b = left[inner], right[inner]
        gain[inner] = impurity[inner] - total[a] / total[inner] * impurity[a] - total[b] / total[inner] * impurity[b]
        cut = [[float(thresholds[f][c])] if f >= 0 else [] for f, c in zip(self.feature.tolist(), self.bin.tolist())]
        split = pa.StructArray.from_arrays(
            [pa.array(self.feature, pa.int32()), pa.array(cut, pa.list_(pa.float64())), pa.array(np.full(n, -1, np.int32))],
            ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
        )
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(counts.ravel()))
        each = {
            "id": np.arange(n, dtype=np.int32), "prediction": counts.argmax(axis=1).astype(np.float64), "impurity": impurity,
            "impurityStats": lists, "rawCount": total.astype(np.int64), "gain": gain, "leftChild": left.astype(np.int32),
            "rightChild": right.astype(np.int32), "split": split,
        }
        node = pa.StructArray.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else v for v in each.values()], list(each))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), node], ["treeID", "nodeData"])


# bins ---------------------------------------------------------------------------------------


def thresholds_of(values: np.ndarray, rows: float, splits: int) -> np.ndarray:
    """Spark ML's split candidates of one feature. ``values`` are sampled, ``rows`` is the number expected of them."""
    seen = values[values != 0]
    value, count = np.unique(seen, return_counts=True)
    count = count.astype(np.float64)
    zeros = rows - len(seen)
    if zeros > _EPSILON * len(seen) * 100:
        at = np.searchsorted(value, 0.0)
        value, count = np.insert(value, at, 0.0), np.insert(count, at, zeros)
    if len(value) - 1 <= splits:
        return (value[:-1] + value[1:]) / 2.0
    stride = rows / (splits + 1)
    found, current, target = [], count[0], stride
    for i in range(1, len(value)):
        before = current
        current += count[i]
        if abs(before - target) < abs(current - target):
            found.append((value[i - 1] + value[i]) / 2.0)
            target += stride
    return np.array(found)


def _sampled(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The rows that Spark ML samples, partition by partition."""
    if fraction >= 1.0:
        return df
    spark = df.sparkSession
    rows = df._jdf.toJavaRDD().sample(False, fraction, draws.sample_seed(seed))
    return DataFrame(spark._jsparkSession.createDataFrame(rows, df._jdf.schema()), spark)


def _matrix(columns: Sequence[pa.Array], what: str) -> np.ndarray:
    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64)
    if np.isnan(x).any():
        raise ValueError(f"{what}: features without values")
    return x


def binned(x: np.ndarray, thresholds: Sequence[np.ndarray]) -> np.ndarray:
    """The first bin whose threshold a value doesn't exceed."""
    return np.column_stack([np.searchsorted(t, x[:, i], side="left") for i, t in enumerate(thresholds)]).astype(np.uint8)


# growing ------------------------------------------------------------------------------------


class _Level:
    """Open nodes in the order in which their features are drawn, with their rows."""

    def __init__(self, node, tree, stats, start, row, weight):
        self.node, self.tree, self.stats, self.start, self.row, self.weight = node, tree, stats, start, row, weight


def _cells(x, y, level, tried, first, last, classes, width):
    """(cell, counts): the occupied (node, place, bin) of the nodes from first to last, in order, and their rows by class."""
    a, b = level.start[first], level.start[last]
    row, weight = level.row[a:b], level.weight[a:b]
    places = tried.shape[1]
    node = np.repeat(np.arange(last - first), np.diff(level.start[first : last + 1]))
    key = (node[:, None] * places + np.arange(places)) * width + x[row[:, None], tried[first + node]]
    span = (last - first) * places * width
    key = (key * classes + y[row][:, None]).ravel()
    weight = np.repeat(weight, places)
    if span * classes <= 2 * len(key):
        dense = np.bincount(key, weight, span * classes).reshape(span, classes)
        cell = np.flatnonzero(dense.any(axis=1))
        return cell, np.ascontiguousarray(dense[cell].T)
    key = np.sort(key << 8 | weight)
    weight, key = key & 255, key >> 8
    cell, kind = np.divmod(key, classes)
    new = np.concatenate([np.ones(1, bool), cell[1:] != cell[:-1]])
    at = np.cumsum(new) - 1
    cell = cell[new]
    return cell, np.bincount(kind * len(cell) + at, weight, classes * len(cell)).reshape(classes, len(cell))


def _best(x, y, level, tried, first, last, impurity, classes, width, least):
    """(node, place, bin, left counts, left impurity, right impurity, gain) of the nodes that a split makes purer."""
    places = tried.shape[1]
    cell, counts = _cells(x, y, level, tried, first, last, classes, width)
    line = cell // width
    begin = np.flatnonzero(np.concatenate([np.ones(1, bool), line[1:] != line[:-1]]))
    left = np.cumsum(counts, axis=1)
    before = left[:, begin] - counts[:, begin]
    left -= np.repeat(before, np.diff(np.append(begin, len(cell))), axis=1)
    node = line // places
    total = level.stats[first:last].sum(axis=1)
    whole = total[node]
    on_left = left.sum(axis=0)
    fits = np.flatnonzero((on_left >= max(least, 1)) & (whole - on_left >= max(least, 1)))
    none = np.empty(0, np.int64)
    if not len(fits):
        return none, none, none, np.empty((0, classes)), np.empty(0), np.empty(0), np.empty(0)
    node, cell, left, on_left, whole = node[fits], cell[fits], left[:, fits], on_left[fits], whole[fits]
    on_right = whole - on_left
    stats = level.stats[first:last].T
    a = gini(left, on_left)
    b = gini([s[node] - c for s, c in zip(stats, left)], on_right)
    gain = impurity[first:last][node] - on_left / whole * a - on_right / whole * b
    edges = np.flatnonzero(np.concatenate([np.ones(1, bool), node[1:] != node[:-1]]))
    top = np.maximum.reduceat(gain, edges)
    hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(edges, len(node)))))
    _, once = np.unique(node[hits], return_index=True)  # the first of equal ones
    best = hits[once]
    best = best[gain[best] > 0]
    return first + node[best], cell[best] // width % places, cell[best] % width, left[:, best].T, a[best], b[best], gain[best]


def grow(
    x: np.ndarray, y: np.ndarray, counts: np.ndarray, trees: Sequence[int], classes: int, subsets: draws.Subsets, depth: int, least: int
) -> dict[int, Tree]:
    """The trees, grown level by level. ``counts`` says for each row (down) how often each tree (across) has it."""
    width = int(x.max(initial=0)) + 1
    order = [*range(len(trees))][::-1]  # as Spark ML opens the roots
    rows = [np.flatnonzero(counts[:, t]) for t in order]
    weight = [counts[r, t].astype(np.int64) for r, t in zip(rows, order)]
    stats = np.array([np.bincount(y[r], w, classes) for r, w in zip(rows, weight)])
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    owner = np.array(order)
    level = _Level(np.arange(len(order)), owner, stats, start, np.concatenate(rows), np.concatenate(weight))
    made = [(owner, stats)]  # of each level: tree and class counts of its nodes, which are numbered on
    splits = []  # of each level: node, feature, bin, gain and left child; the right child is the next one
    n = len(order)
    for deep in range(depth):
        if not len(level.node):
            break
        tried = subsets.take(len(level.node))
        impurity = gini(level.stats.T, level.stats.sum(axis=1))
        found, first = [], 0
        while first < len(level.node):
            last = int(np.searchsorted(level.start, level.start[first] + STEP_CELLS // tried.shape[1], side="right")) - 1
            last = min(max(last, first + 1), len(level.node), first + (1 << 20))
            if level.start[last] > level.start[first]:
                found.append(_best(x, y, level, tried, first, last, impurity, classes, width, least))
            first = last
        if not found:
            break
        at, place, cut, left, pure_a, pure_b, gain = (np.concatenate(v) for v in zip(*found))
        if not len(at):
            break
        feature = tried[at, place]
        child = n + 2 * np.arange(len(at))
        splits.append((level.node[at], feature, cut, gain, child))
        both = np.empty((2 * len(at), classes))
        both[::2], both[1::2] = left, level.stats[at] - left
        made.append((np.repeat(level.tree[at], 2), both))
        n += 2 * len(at)
        # open children, in the order in which Spark ML takes them from its stack
        is_open = np.column_stack([np.abs(pure_a) >= _EPSILON, np.abs(pure_b) >= _EPSILON]) & (deep + 1 < depth)
        spot, side = np.nonzero(is_open)
        rank = np.zeros(len(trees), np.int64)
        numbers = sorted({trees[t] for t in np.unique(level.tree)})
        place_of = {t: i for i, t in enumerate(trees)}
        for i, t in enumerate(draws.map_order(numbers)):
            rank[place_of[t]] = i
        turn = np.lexsort((side, at[spot], rank[level.tree[at[spot]]]))[::-1]
        spot, side = spot[turn], side[turn]
        # where the rows of a split node go
        split_at = np.full(len(level.node), -1)
        split_at[at] = np.arange(len(at))
        goes = np.full((len(at), 2), -1)
        goes[spot, side] = np.arange(len(spot))
        of = np.repeat(split_at, np.diff(level.start))
        keep = np.flatnonzero(of >= 0)
        of, row, w = of[keep], level.row[keep], level.weight[keep]
        to = goes[of, (x[row, feature[of]] > cut[of]).astype(np.int64)]
        keep = np.flatnonzero(to >= 0)
        key = np.sort(to[keep] << 32 | keep)
        pick = key & 0xFFFFFFFF
        start = np.searchsorted(key >> 32, np.arange(len(spot) + 1))
        level = _Level(child[spot] + side, level.tree[at[spot]], both[2 * spot + side], start, row[pick], w[pick])
    return _trimmed(made, splits, n, trees, classes, subsets.features)


def _trimmed(made, splits, n, trees, classes, features) -> dict[int, Tree]:
    """Trees in preorder, without splits whose sides are leaves that predict the same."""
    owner, stats = (np.concatenate(v) for v in zip(*made))
    feature, cut, child, gain = np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.full(n, -1), np.zeros(n)
    for node, f, c, g, first in splits:
        feature[node], cut[node], child[node], gain[node] = f, c, first, g
    predicted = stats.argmax(axis=1)
    size = np.ones(n, np.int64)
    for node, *_, first in reversed(splits):
        same = (feature[first] < 0) & (feature[first + 1] < 0) & (predicted[first] == predicted[first + 1])
        feature[node[same]] = -1
        size[node] = np.where(same, 1, 1 + size[first] + size[first + 1])
    number = np.zeros(n, np.int64)  # within the tree
    kept = np.zeros(n, bool)
    kept[: len(made[0][0])] = True
    for node, *_, first in splits:
        node, first = node[inner := kept[node] & (feature[node] >= 0)], first[inner]
        kept[first] = kept[first + 1] = True
        number[first] = number[node] + 1
        number[first + 1] = number[first] + size[first]
    out = {}
    some = np.flatnonzero(kept)
    some = some[np.lexsort((number[some], owner[some]))]
    for t, ids in zip(np.unique(owner[some]), np.split(some, np.flatnonzero(np.diff(owner[some])) + 1)):
        leaf = feature[ids] < 0
        values, which = np.unique(stats[ids[leaf]].astype(np.int64), axis=0, return_inverse=True)
        link = np.empty(len(ids), np.int32)
        link[leaf] = which.ravel()
        inner = ids[~leaf]
        link[~leaf] = number[child[inner] + 1]
        weighed = np.bincount(feature[inner], gain[inner] * stats[inner].sum(axis=1), features)
        out[trees[t]] = Tree(feature[ids], cut[ids], link, values, weighed)
    return out


# the model ----------------------------------------------------------------------------------


def fit(
    df: DataFrame, features: Sequence[str], target: str, rows: int, classes: int, n_trees: int, depth: int, least: int, seed: int
) -> Forest:
    """A forest on the rows of ``df``, of which there are ``rows``, with labels 0..classes-1."""
    if classes < 2:
        raise ValueError("a forest needs two classes or more")
    if not 0 <= depth <= 30:
        raise ValueError("the depth must be from 0 to 30")
    spark, features = df.sparkSession, list(features)
    ship(spark)
    plain = df.select(*[F.col(f"`{f}`").cast("double").alias(f"__{i}") for i, f in enumerate(features)], F.col(f"`{target}`").cast("double").alias("__y"))
    fraction = min(1.0, max(BINS * BINS, SAMPLED) / rows)
    sampled = _sampled(plain, fraction, seed).toArrow()
    x = _matrix([sampled.column(i).combine_chunks() for i in range(len(features))], "Random Forest")
    splits = min(BINS, rows) - 1
    thresholds = [thresholds_of(x[:, i], fraction * rows, splits) for i in range(len(features))]
    tried = len(features) if n_trees == 1 else math.ceil(math.sqrt(len(features)))
    tasks = max(1, min(n_trees, MOST_TASKS, rows * n_trees // TASK_CELLS))
    groups = [g.tolist() for g in np.array_split(np.arange(n_trees), tasks)]
    small = np.min_scalar_type(classes - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = draws.Poisson(seed + TaskContext.get().partitionId() + 1)
        for batch in batches:
            y = batch.column(len(features)).to_numpy(zero_copy_only=False).astype(np.float64)
            if not ((y >= 0) & (y < classes) & (y == np.floor(y))).all():
                raise ValueError(f"labels must be 0..{classes - 1}")
            bins = binned(_matrix(batch.columns[: len(features)], "Random Forest"), thresholds)
            counts = counted.counts(len(y) * n_trees).reshape(-1, n_trees)
            for g, trees in enumerate(groups):
                some = counts[:, trees]
                used = some.any(axis=1)
                parts = (bins[used], y[used].astype(small), some[used])
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["g", "x", "y", "counts"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                dealt.setdefault(r["g"], []).append(r)
        for g in sorted(dealt):
            parts, trees = dealt.pop(g), groups[g]
            x = np.frombuffer(b"".join(r["x"] for r in parts), np.uint8).reshape(-1, len(features))
            y = np.frombuffer(b"".join(r["y"] for r in parts), small).astype(np.int64)
            counts = np.frombuffer(b"".join(r["counts"] for r in parts), np.uint8).reshape(-1, len(trees))
            del parts
            subsets = draws.Subsets(seed ^ g * 0x9E3779B97F4A7C15, len(features), tried)
            for t, tree in grow(x, y, counts, trees, classes, subsets, depth, least).items():
                yield tree.row(t)

    dealt = plain.mapInArrow(deal, "g int, x binary, y binary, counts binary").repartitionById(tasks, F.col("g"))
    trees = {r["tree"]: Tree.unpacked(r, classes) for b in dealt.mapInArrow(grown, _TREE).toArrow().to_batches() for r in b.to_pylist()}
    return Forest(len(features), classes, thresholds, [trees[t] for t in range(n_trees)])


class Forest(Model, MLReadable, MLWritable):
    """A fitted forest: a few bytes a node, of which the driver and each scoring task hold all."""

    def __init__(self, n_features: int = 0, classes: int = 0, thresholds: Sequence[np.ndarray] = (), trees: Sequence[Tree] = ()):
        super().__init__()
        self.n_features, self.classes, self.thresholds, self.trees = n_features, classes, list(thresholds), list(trees)
        self._sent = None

    @property
    def treeWeights(self) -> list[float]:  # noqa: N802  as Spark ML's models have it
        return [1.0] * len(self.trees)

    def importances(self) -> np.ndarray:
        """Gains weighted by rows: shares within each tree, added up, as shares."""
        total = np.zeros(self.n_features)
        for tree in self.trees:
            if (whole := tree.importance.sum()) > 0:
                total += tree.importance / whole
        return total / total.sum() if total.sum() > 0 else total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.thresholds)
        votes = np.zeros((len(x), self.classes))
        for tree in self.trees:
            votes += tree.votes(bins)
        total = np.zeros(len(x))
        for c in range(self.classes):
            total += votes[:, c]
        return votes / np.where(total > 0, total, 1.0)[:, None]

    def attach(self, df: DataFrame, features: Sequence[str], column: str) -> DataFrame:
        """Add the class probabilities of each row."""
        model = self._shared(df.sparkSession)
        n, classes, names = self.n_features, self.classes, [f.name for f in df.schema] + [column]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = None
            for batch in batches:
                forest = forest or _Scorer(n, *model.value)
                p = Forest.probabilities(forest, _matrix([batch.column(f) for f in features], "Random Forest"))
                offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * classes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names)

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))]))

    def _shared(self, spark: SparkSession):
        """(classes, thresholds, trees), broadcast once: they go from file to file, past the heap of the driver's JVM."""
        ship(spark)
        context = spark.sparkContext
        if self._sent is None or self._sent[0] != context.applicationId:
            self._sent = (context.applicationId, context.broadcast((self.classes, self.thresholds, self.trees)))
        return self._sent[1]

    def _by_tree(self, spark: SparkSession, row, schema: str) -> DataFrame:
        """What ``row`` makes of the thresholds, each tree and its number."""
        model = self._shared(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    _, thresholds, trees = model.value
                    yield row(thresholds, trees[t], t)

        slices = max(1, min(len(self.trees), spark.sparkContext.defaultParallelism))
        return spark.range(0, len(self.trees), 1, slices).mapInArrow(run, schema)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """(treeID, nodeData): a row per node, in the columns of Spark ML's saved forests."""
        return self._by_tree(spark, lambda thresholds, tree, t: tree.nodes(thresholds, t), f"treeID int, nodeData struct<{NODE}>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError("a forest is attached to its feature columns")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Scorer:
    """What ``Forest.probabilities`` needs, without Spark's parameters."""

    def __init__(self, n_features: int, classes: int, thresholds: list, trees: list):
        self.n_features, self.classes, self.thresholds, self.trees = n_features, classes, thresholds, trees


class _Writer(MLWriter):
    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:  # noqa: N802
        forest = self.forest
        told = {"nFeatures": forest.n_features, "classes": forest.classes, "thresholds": [t.tolist() for t in forest.thresholds]}
        DefaultParamsWriter.saveMetadata(forest, path, self.sparkSession, extraMetadata={"forest": json.dumps(told)})
        forest._by_tree(self.sparkSession, lambda _, tree, t: tree.row(t), _TREE).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Forest:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark, f"{self.cls.__module__}.{self.cls.__name__}")
        told = json.loads(metadata["forest"])
        trees = {r["tree"]: Tree.unpacked(r, told["classes"]) for r in spark.read.parquet(f"{path}/data").toLocalIterator()}
        forest = Forest(told["nFeatures"], told["classes"], [np.array(t, np.float64) for t in told["thresholds"]], [trees[t] for t in sorted(trees)])
        return forest._resetUid(metadata["uid"])

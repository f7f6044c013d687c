"""Perturbation of feature columns and the damage it does to predictions.

A row is perturbed once per test of the suite inside the scan stage, by an array kernel on Arrow batches: a batch's features
are one matrix and a test's settings are rows of numbers, so neither code nor plans grow with features or tests. The rows stay
in that stage through scoring, and only confusion counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, keyed, text
from ..session import ship, small_frame
from . import evaluate, scoring
from .selection import NOTHING, cuts

RESULT_KEYS = ("model", "model_seq", "split", "test_seq", "test_name")


@dataclass(frozen=True)
class StressTest:
    type: str
    params: Mapping[str, float | str] = field(default_factory=dict)
    name: str | None = None

    @property
    def title(self) -> str:
        return self.name or self.type


# The default suite.
DEFAULT_SUITE = (
    StressTest("gaussian_noise", {"noise_level": 0.05}, "Gaussian Noise (Low)"),
    StressTest("gaussian_noise", {"noise_level": 0.15}, "Gaussian Noise (Medium)"),
    StressTest("gaussian_noise", {"noise_level": 0.3}, "Gaussian Noise (High)"),
    StressTest("uniform_noise", {"noise_range": 0.05}, "Uniform Noise (Low)"),
    StressTest("uniform_noise", {"noise_range": 0.15}, "Uniform Noise (Medium)"),
    StressTest("uniform_noise", {"noise_range": 0.3}, "Uniform Noise (High)"),
    StressTest("feature_dropout", {"dropout_rate": 0.1}, "Feature Dropout (10%)"),
    StressTest("feature_dropout", {"dropout_rate": 0.2}, "Feature Dropout (20%)"),
    StressTest("feature_dropout", {"dropout_rate": 0.3}, "Feature Dropout (30%)"),
    StressTest("feature_corruption", {"corruption_rate": 0.05, "corruption_type": "zero"}, "Corruption (5%, zero)"),
    StressTest("feature_corruption", {"corruption_rate": 0.15, "corruption_type": "random"}, "Corruption (15%, random)"),
    StressTest("feature_corruption", {"corruption_rate": 0.25, "corruption_type": "extreme"}, "Corruption (25%, extreme)"),
    StressTest("scale_perturbation", {"scale_factor": 1.5}, "Scale Perturbation (1.5x)"),
    StressTest("scale_perturbation", {"scale_factor": 2.0}, "Scale Perturbation (2.0x)"),
    StressTest("scale_perturbation", {"scale_factor": 2.5}, "Scale Perturbation (2.5x)"),
    StressTest("distribution_shift", {"shift_type": "mean", "shift_amount": 0.5}, "Mean Shift (0.5)"),
    StressTest("distribution_shift", {"shift_type": "mean", "shift_amount": 1.0}, "Mean Shift (1.0)"),
    StressTest("distribution_shift", {"shift_type": "variance", "shift_amount": 0.5}, "Variance Shift (0.5)"),
    StressTest("distribution_shift", {"shift_type": "variance", "shift_amount": 1.5}, "Variance Shift (1.5)"),
)

# Amount parameter, its default and its accepted range per test type.
AMOUNTS = {
    "gaussian_noise": ("noise_level", 0.1, 0.0, 1.0),
    "uniform_noise": ("noise_range", 0.1, 0.0, 0.5),
    "feature_dropout": ("dropout_rate", 0.2, 0.0, 0.8),
    "feature_corruption": ("corruption_rate", 0.1, 0.0, 0.5),
    "scale_perturbation": ("scale_factor", 1.5, 1.0, 3.0),
    "distribution_shift": ("shift_amount", 0.5, 0.0, 2.0),
}
CORRUPTION_TYPES = ("zero", "mean", "random", "extreme")
SHIFT_TYPES = ("mean", "variance")

_SLOTS = 3
_PART = "__part"
# Bytes of settings that go to the tasks at once (parts x tests x features x 48), and cells worked on at once.
SETTINGS_BYTES, STEP_CELLS = 64 << 20, 1 << 18
_RANDOM = ("gaussian_noise", "uniform_noise", "feature_dropout", "feature_corruption")


def amount(test: StressTest) -> float:
    name, default, _, _ = AMOUNTS[test.type]
    return float(test.params.get(name, default))


def flavour(test: StressTest) -> str:
    """Test type, qualified by the corruption or shift type."""
    if test.type == "feature_corruption":
        return f"corrupt_{test.params.get('corruption_type', 'zero')}"
    if test.type == "distribution_shift":
        return f"shift_{test.params.get('shift_type', 'mean')}"
    return test.type


def check(test: StressTest) -> StressTest:
    """Range check of a single test's parameters."""
    if test.type not in AMOUNTS:
        raise ValueError(f"unknown stress type: {test.type}")
    name, _, lo, hi = AMOUNTS[test.type]
    if not lo <= amount(test) <= hi:
        raise ValueError(f"{name} must lie in [{lo}, {hi}]")
    if test.type == "feature_corruption" and flavour(test)[8:] not in CORRUPTION_TYPES:
        raise ValueError(f"unknown corruption type: {test.params['corruption_type']}")
    if test.type == "distribution_shift" and flavour(test)[6:] not in SHIFT_TYPES:
        raise ValueError(f"unknown shift type: {test.params['shift_type']}")
    return test


def usable(tests: Sequence[StressTest]) -> list[StressTest]:
    """Known types only; a repeated name keeps its place and takes the last settings."""
    by_name = {t.title: t for t in tests if t.type in AMOUNTS}
    return list(by_name.values())


def feature_stats(df: DataFrame, features: Sequence[str], part: str) -> dict:
    """Per value of ``part`` the row count and each feature's mean, population deviation, minimum, maximum.

    One aggregate over the cells of a row: the same five functions, combined map-side, for any number of features.
    """
    cells = f"posexplode(array({', '.join(f'cast(`{f}` AS double)' for f in features)})) AS (__at, x)"
    found = df.selectExpr(part, cells).groupBy(part, "__at")
    measures = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    out: dict = {}
    for r in found.agg(F.count(F.lit(1)).alias("n"), *[f("x").alias(m) for m, f in measures.items()]).collect():
        own = out.setdefault(r[part], {"n": r["n"]})
        own[features[r["__at"]]] = {m: r[m] for m in measures}
    return out


def coin_factor(test: StressTest, feature: str, seed: int) -> float:
    """One draw per column: multiply or divide the whole column."""
    factor = amount(test)
    return factor if keyed.driver_uniform(seed, "coin", test.title, feature) > 0.5 else 1.0 / factor


def test_coefficients(test: StressTest, seed: int) -> list[list[int]]:
    """The linear maps that turn a row's words into the words of one test."""
    return [keyed.coefficients(seed, "test", test.title, i) for i in range(keyed.WORDS)]


_WORDS = [f"__w_{i}" for i in range(keyed.WORDS)]


def _with_words(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.selectExpr("*", f"{keyed.row_digest(seed, key)} AS __digest").selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"{keyed.word('__digest', i)} AS {w}" for i, w in enumerate(_WORDS)]
    )


class _Draws:
    """Draws of rows (four words each) under the labels (test, feature, slot): matrices of rows by features."""

    def __init__(self, features: Sequence[str], slots: int):
        self.lines = [np.array([keyed.coefficients(f, s) for f in features], np.int64).reshape(-1, keyed.WORDS) for s in range(slots)]

    def of(self, words: np.ndarray, own: Sequence[Sequence[int]], slots: int) -> list[np.ndarray]:
        terms = words @ np.array(own, np.int64).T % keyed.PRIME
        return [keyed.fifth_powers(terms @ line.T % keyed.PRIME) for line in self.lines[:slots]]


def _corruption_cuts(df, features, tests, key, seed, sizes) -> dict:
    """Cut-off of the exact int(n * rate) rows for every (part, corruption test, feature)."""
    hit = [t for t in tests if t.type == "feature_corruption"]
    if not hit:
        return {}
    drawn, maps, m = _Draws(features, 2), [test_coefficients(t, seed) for t in hit], len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch, m):
                words = _matrix(part, _WORDS, np.int64)
                rows = pa.array(np.repeat(np.arange(part.num_rows), m))
                own = part.select([_PART, key]).take(rows)
                for k, coefs in enumerate(maps):
                    order = keyed.fine_uniforms(*drawn.of(words, coefs, 2)).ravel()
                    cell = np.tile(np.arange(k * m, (k + 1) * m), part.num_rows)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell), pa.array(order)], [_PART, key, "cell", "draw"])

    own = df.select(_PART, key)
    schema = T.StructType([*own.schema.fields, T.StructField("cell", T.LongType()), T.StructField("draw", T.DoubleType())])
    draws = _with_words(own, key, seed).mapInArrow(run, schema)
    takes = {(p, k * m + j): [int(n * amount(t))] for p, n in sizes.items() for k, t in enumerate(hit) for j in range(m)}
    found = cuts(draws, [_PART, "cell"], "draw", key, takes, {g: sizes[g[0]] for g in takes})
    return {(p, hit[c // m].title, features[c % m]): cut for ((p, c), _), cut in found.items()}


def _steps(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, STEP_CELLS // max(1, width))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _matrix(batch: pa.RecordBatch, columns: Sequence[str], kind) -> np.ndarray:
    """Rows by columns; a null is NaN in a matrix of doubles."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(kind, copy=False)


def perturb(
    df: DataFrame,
    features: Sequence[str],
    tests: Sequence[StressTest],
    key: str = "row_id",
    seed: int = 42,
) -> DataFrame:
    """Every row once per test with its features perturbed, plus ``test_seq`` and ``test_name``.

    Statistics and selection sizes are those of ``df``, so pass the one split under test. The
    key must be unique: it alone decides the draws, whatever the partitioning.
    """
    tests = usable(tests)
    named = text.lookup([t.title for t in tests], "test_seq")
    moved = _perturb(df.withColumn(_PART, F.lit(0)), features, tests, key, seed)
    return moved.drop(_PART).withColumn("test_name", named)


def cell_settings(test: StressTest, feature: str, stat: Mapping[str, float], cut: float, seed: int) -> dict:
    """Numbers that make one formula serve every test type:

    a cell whose rank draw is at most ``cut`` becomes ``base + span * w``; any other cell becomes
    ``x * mul + add + amp * noise``.
    """
    size, mean, std, lo, hi = amount(test), stat["mean"], stat["std"], stat["min"], stat["max"]
    cell = {"mul": 1.0, "add": 0.0, "amp": 0.0, "cut": NOTHING.value, "base": 0.0, "span": 0.0}
    replaced = {"zero": (0.0, 0.0), "mean": (mean, 0.0), "random": (lo, hi - lo), "extreme": (lo, hi - lo)}
    change = {
        "gaussian_noise": lambda: {"amp": std * size},
        "uniform_noise": lambda: {"amp": (hi - lo) * size},
        "feature_dropout": lambda: {"cut": size},
        "scale_perturbation": lambda: {"mul": coin_factor(test, feature, seed)},
        "shift_mean": lambda: {"add": std * size},
        "shift_variance": lambda: {"mul": size, "add": mean - mean * size},
        **{
            f"corrupt_{name}": lambda b=base, s=span: {"cut": cut, "base": b, "span": s}
            for name, (base, span) in replaced.items()
        },
    }
    kind = flavour(test)
    if kind not in change:
        raise ValueError(f"unknown perturbation: {kind}")
    return {**cell, **change[kind]()}


class _Kernel:
    """Perturbs batches: the rows once for each test, with the settings of their part."""

    def __init__(self, features, tests, stats, cut_of, seed, columns, key):
        self.features, self.columns, self.key = list(features), columns, key
        self.draws = _Draws(features, _SLOTS)
        self.maps = [test_coefficients(t, seed) for t in tests]
        self.kinds = [flavour(t) for t in tests]
        self.random = [t.type in _RANDOM for t in tests]
        self.cells, self.ties = {}, {}
        for part, stat in stats.items():
            for i, t in enumerate(tests):
                found = [cut_of.get((part, t.title, f), NOTHING) for f in features]
                cells = [cell_settings(t, f, stat[f], cut.value, seed) for f, cut in zip(features, found)]
                self.cells[part, i] = {name: np.array([c[name] for c in cells], np.float64) for name in cells[0]}
                self.ties[part, i] = [(j, cut.keys) for j, cut in enumerate(found) if cut.keys]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in _steps(batch, len(self.features)):
                parts = step.column(_PART).to_numpy()
                for part in np.unique(parts).tolist():
                    rows = step if (parts == part).all() else step.take(pa.array(np.flatnonzero(parts == part)))
                    yield from self.moved(rows, part)

    def moved(self, rows: pa.RecordBatch, part: int) -> Iterator[pa.RecordBatch]:
        x = _matrix(rows, self.features, np.float64)
        blank = np.column_stack([rows.column(f).is_null().to_numpy(zero_copy_only=False) for f in self.features])
        words = _matrix(rows, _WORDS, np.int64) if any(self.random) else None
        for i in range(len(self.kinds)):
            value, empty = self.value(x, blank, words, part, i, rows)
            new = {f: pa.array(value[:, j], mask=empty[:, j]) for j, f in enumerate(self.features)}
            new["test_seq"] = pa.array(np.full(len(x), i, np.int32))
            yield pa.RecordBatch.from_arrays([new[c] if c in new else rows.column(c) for c in self.columns], self.columns)

    def value(self, x, blank, words, part, i, rows) -> tuple[np.ndarray, np.ndarray]:
        """The new cells, and which of them are null."""
        cell, kind = self.cells[part, i], self.kinds[i]
        kept = x * cell["mul"] + cell["add"]
        if not self.random[i]:
            return kept, blank
        high, low, third = self.draws.of(words, self.maps[i], _SLOTS)
        u = keyed.open_uniforms(high)
        if cell["amp"].any():
            noise = keyed.normals(u, keyed.open_uniforms(low)) if kind == "gaussian_noise" else u * 2.0 - 1.0
            kept = kept + np.where(cell["amp"] == 0, 0.0, noise * cell["amp"])
        order = keyed.fine_uniforms(high, low)
        chosen = order <= cell["cut"]
        if kind == "feature_dropout":
            chosen &= ~blank
        for j, keys in self.ties[part, i]:
            listed = np.isin(np.array([str(k) for k in rows.column(self.key).to_pylist()]), keys)
            chosen[:, j] &= (order[:, j] < cell["cut"][j]) | listed
        w = keyed.open_uniforms(third)
        replaced = cell["base"] + cell["span"] * (w >= 0.5 if kind == "corrupt_extreme" else w)
        return np.where(chosen, replaced, kept), blank & ~chosen


def _perturb(df: DataFrame, features: Sequence[str], tests: list[StressTest], key: str, seed: int) -> DataFrame:
    """Every row once per test. Rows of one ``_PART`` are perturbed with its statistics and exact numbers of cells.

    The settings go to the tasks with the kernel; a suite whose settings would pass ``SETTINGS_BYTES`` is run in groups of tests.
    """
    if not tests:
        raise ValueError("no usable stress tests")
    ship(df.sparkSession)
    stats = feature_stats(df, features, _PART)
    blank = sorted({f for f in features for s in stats.values() if s[f]["mean"] is None})
    if blank or not stats:
        raise ValueError(f"features without values: {blank or list(features)}")
    cut_of = _corruption_cuts(df, features, tests, key, seed, {p: s["n"] for p, s in stats.items()})
    doubles = {f: T.StructField(f, T.DoubleType()) for f in features}
    schema = T.StructType([*[doubles.get(f.name, f) for f in df.schema.fields], T.StructField("test_seq", T.IntegerType())])
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])
    rows = _with_words(values, key, seed) if any(t.type in _RANDOM for t in tests) else values
    together = max(1, SETTINGS_BYTES // (48 * len(stats) * max(1, len(features))))
    groups = []
    for a in range(0, len(tests), together):
        kernel = _Kernel(features, tests[a : a + together], stats, cut_of, seed, schema.names, key)
        moved = rows.mapInArrow(kernel.run, schema)
        groups.append(moved.withColumn("test_seq", F.col("test_seq") + a) if a else moved)
    return reduce(DataFrame.unionByName, groups)


def _parted(df: DataFrame, split: str) -> DataFrame:
    """``df`` with a number for its split; the splits are the few names of the ``split`` column."""
    kind = df.schema[split].dataType
    names = [r[0] for r in df.select(split).distinct().orderBy(split).collect()]
    schema = T.StructType([T.StructField("__name", kind), T.StructField(_PART, T.IntegerType())])
    table = small_frame(df.sparkSession, [(n, i) for i, n in enumerate(names)], schema)
    return df.join(table, F.col(split).eqNullSafe(F.col("__name"))).drop("__name")


def _scored_tests(scorers, df, features, tests, key, target, split, seed) -> DataFrame:
    """One row per (row, test) with the label before and after of every scorer, side by side.

    Each split is perturbed with its own statistics and selection sizes, all splits in one pass.
    """
    scored = scoring.attach_all(scorers, _parted(df, split), features, "__o_")
    base = scored.select(
        _PART,
        F.col(key).alias("row_id"),
        F.col(split).alias("split"),
        F.col(target).cast("int").alias("y_true"),
        *features,
        *[arrays.argmax(F.col(f"__o_{i}")).alias(f"__before_{i}") for i in range(len(scorers))],
    )
    moved = scoring.attach_all(scorers, _perturb(base, features, tests, "row_id", seed), features, "__s_")
    return moved.select(
        "split",
        "row_id",
        "test_seq",
        "y_true",
        *[f"__before_{i}" for i in range(len(scorers))],
        *[arrays.argmax(F.col(f"__s_{i}")).alias(f"__after_{i}") for i in range(len(scorers))],
    )


def _counted_tests(wide: DataFrame, n_scorers: int) -> DataFrame:
    """Confusion counts per (model, split, test) with the original hits and agreements.

    Label and the two flags of a scorer are packed into one number, so the scorers unpivot into
    a plain expansion of the row and are grouped under a few integers.
    """
    ids = ["split", "test_seq", "y_true"]
    packed = [
        f"__after_{i} * 4 + CASE WHEN __before_{i} = __after_{i} THEN 2 ELSE 0 END "
        f"+ CASE WHEN __before_{i} = y_true THEN 1 ELSE 0 END AS `{i}`"
        for i in range(n_scorers)
    ]
    cells = (
        wide.selectExpr(*ids, *packed)
        .unpivot(ids, [F.col(f"`{i}`") for i in range(n_scorers)], "__model", "__code")
        .groupBy("__model", *ids, "__code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cells.selectExpr(
        "cast(__model AS int) AS model_seq",
        *ids,
        "shiftright(__code, 2) AS y_pred",
        "n",
        "CASE WHEN __code & 1 = 1 THEN n ELSE 0L END AS hits_before",
        "CASE WHEN __code & 2 = 2 THEN n ELSE 0L END AS same",
    )


def _named(df: DataFrame, scorers: Sequence, tests: Sequence[StressTest]) -> DataFrame:
    return df.select(
        text.lookup([s.name for s in scorers], "model_seq").alias("model"),
        text.lookup([t.title for t in tests], "test_seq").alias("test_name"),
        "*",
    )


def stress_predictions(
    scorers: Sequence,
    df: DataFrame,
    features: Sequence[str],
    tests: Sequence[StressTest] = DEFAULT_SUITE,
    key: str = "row_id",
    target: str = "y",
    split: str = "split",
    seed: int = 42,
) -> DataFrame:
    """Original and stressed prediction of every (model, test, row); the original is scored once."""
    tests = usable(tests)
    wide = _scored_tests(scorers, df, features, tests, key, target, split, seed)
    per_model = F.array(
        *[
            F.struct(
                F.lit(i).alias("model_seq"),
                F.col(f"__before_{i}").alias("y_pred_original"),
                F.col(f"__after_{i}").alias("y_pred_stressed"),
            )
            for i in range(len(scorers))
        ]
    )
    return _named(wide.select("split", "row_id", "test_seq", "y_true", F.inline(per_model)), scorers, tests)


def results(stressed: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """stress_results: accuracies, drop, stressed precision/recall/F1 and agreement per test."""
    counts = stressed.groupBy(*keys, "y_true", F.col("y_pred_stressed").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("y_pred_original") == F.col("y_true"), F.lit(1))).alias("hits_before"),
        F.count(F.when(F.col("y_pred_original") == F.col("y_pred_stressed"), F.lit(1))).alias("same"),
    )
    return _results_from_counts(counts, keys)


def _results_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    rolled = evaluate.metrics_from_confusion(counts, keys, carry=("hits_before", "same"))
    before = F.col("accuracy_original")
    return (
        rolled.withColumn("accuracy_original", F.col("hits_before") / F.col("n"))
        .withColumn("performance_drop", before - F.col("accuracy"))
        .select(
            *keys,
            "accuracy_original",
            F.col("accuracy").alias("accuracy_stressed"),
            "performance_drop",
            F.when(before > 0, F.col("performance_drop") / before * F.lit(100.0))
            .otherwise(F.lit(0.0))
            .alias("performance_drop_pct"),
            F.col("precision").alias("precision_stressed"),
            F.col("recall").alias("recall_stressed"),
            F.col("f1").alias("f1_stressed"),
            (F.col("same") / F.col("n")).alias("prediction_agreement"),
        )
    )


def run(
    scorers: Sequence,
    df: DataFrame,
    features: Sequence[str],
    tests: Sequence[StressTest] = DEFAULT_SUITE,
    key: str = "row_id",
    target: str = "y",
    split: str = "split",
    seed: int = 42,
) -> DataFrame:
    """Run a suite of tests for all scorers over every split of ``df``, each on its own.

    Rows are counted under integer codes; the names are put on the small result.
    """
    tests = usable(tests)
    wide = _scored_tests(scorers, df, features, tests, key, target, split, seed)
    counts = _counted_tests(wide, len(scorers))
    return _named(_results_from_counts(counts, ("model_seq", "split", "test_seq")), scorers, tests)


def single(scorers, df, features, test: StressTest, **kwargs) -> DataFrame:
    """One range-checked test."""
    return run(scorers, df, features, [check(test)], **kwargs)


def summary(result: DataFrame) -> DataFrame:
    """Formatted row per model and test."""
    return result.select(
        "model",
        "test_name",
        text.percent(F.col("accuracy_original"), 2).alias("original_acc"),
        text.percent(F.col("accuracy_stressed"), 2).alias("stressed_acc"),
        text.fixed(F.col("performance_drop_pct"), 1, "%").alias("drop_pct"),
        text.percent(F.col("prediction_agreement"), 2).alias("agreement"),
        text.percent(F.col("f1_stressed"), 2).alias("f1"),
    )


def series(result: DataFrame) -> DataFrame:
    """Chart data: drop %, original and stressed accuracy and agreement as percentages."""
    hundred = F.lit(100.0)
    return result.select(
        "model",
        "test_name",
        F.col("performance_drop_pct").alias("drop"),
        (F.col("accuracy_original") * hundred).alias("original"),
        (F.col("accuracy_stressed") * hundred).alias("stressed"),
        (F.col("prediction_agreement") * hundred).alias("agreement"),
    ).unpivot(["model", "test_name"], ["drop", "original", "stressed", "agreement"], "series", "value")


def most_challenging(result: DataFrame, model: str, n: int = 5) -> DataFrame:
    """Tests of a model with the largest drop %, in suite order on ties."""
    return (
        result.filter(F.col("model") == model)
        .orderBy(F.desc("performance_drop_pct"), "test_seq")
        .limit(n)
        .select(
            "test_name",
            text.fixed(F.col("performance_drop_pct"), 1, "%").alias("performance_drop"),
            text.percent(F.col("accuracy_stressed"), 2).alias("stressed_accuracy"),
        )
    )

"""Exact order statistics without sorting or collecting a whole group.

``percentile`` keeps every distinct value of a group in one task. Here a mergeable quantile
sketch narrows each wanted rank to a bracket (map-side combined, no shuffle of rows) until the
bracket is small; only the bracket's values are then counted, sorted and indexed exactly.
Ranks are always verified against exact counts, so the sketch only affects speed.

Two scans do for most tables: the sketch rides along with whatever else is aggregated in the first, and the second counts the
brackets' values. ``column_quantiles`` does so for many columns at once without a row per cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship, small_frame

BRACKET_ROWS = 250_000
GRID = 1000
SKETCH_ACCURACY = 10_000
# Fewer values than this are all counted: brackets would hold most of them.
SMALL_GROUP = 4 * SKETCH_ACCURACY
_MARGIN = 2
_ROUNDS = 12


def _bracket_schema(values: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(c, values.schema[c].dataType) for c in by]


def _with_brackets(values: DataFrame, by: Sequence[str], brackets: Mapping) -> DataFrame:
    """Rows at or below the upper end of each bracket of their group.

    The bracket table has one row per group and wanted rank, so it is broadcast by its size.
    """
    fields = _bracket_schema(values, by)
    rows = [(*g, i, lo, hi) for (g, i), (lo, hi) in brackets.items()]
    schema = T.StructType(
        [
            *fields,
            T.StructField("__slot", T.IntegerType()),
            T.StructField("__lo", T.DoubleType()),
            T.StructField("__hi", T.DoubleType()),
        ]
    )
    if not by:
        bounds = [
            F.struct(
                F.lit(i).alias("__slot"),
                F.lit(lo).cast("double").alias("__lo"),
                F.lit(hi).cast("double").alias("__hi"),
            )
            for (_, i), (lo, hi) in brackets.items()
        ]
        joined = values.select("*", F.inline(F.array(*bounds)))
    else:
        joined = values.join(small_frame(values.sparkSession, rows, schema), list(by))
    return joined.filter(F.col("__hi").isNull() | (F.col("__v") <= F.col("__hi")))


def sketch(value: str, fractions: Sequence[float], accuracy: int) -> Column:
    """Approximate quantiles; the fractions are one parsed constant, not thousands of literals."""
    listed = ", ".join(f"{f!r}D" for f in fractions)
    return F.expr(f"percentile_approx({value}, array({listed}), {accuracy})")


def select_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ranks: Mapping[tuple, Sequence[int]],
    start: Mapping[tuple, tuple[float, float]] | None = None,
    counts: Mapping[tuple, int] | None = None,
    bracket_rows: int = BRACKET_ROWS,
    inside: Mapping[tuple, float] | None = None,
) -> dict[tuple[tuple, int], tuple[float, int, int]]:
    """{(group, rank): (value, rows below it, rows equal to it)} for 0-based ranks.

    ``start`` may give a first bracket per (group, rank), taken as narrow enough unless ``inside`` says how many rows it may
    hold, and ``counts`` the group sizes. Null group keys are not selected.
    """
    by = list(by)
    values = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    wanted = [(g, r) for g, rs in ranks.items() for r in dict.fromkeys(rs)]
    if not wanted:
        return {}
    known = dict(counts or {})
    bracket = {w: (start or {}).get(w, (None, None)) for w in wanted}
    exact_start = bool(start) and inside is None
    estimate = {w: (inside or {}).get(w, known.get(w[0], math.inf)) for w in wanted}
    found: dict = {}

    for _ in range(_ROUNDS):
        wide = {} if exact_start else {
            w: b for w, b in bracket.items() if w not in found and estimate[w] > bracket_rows
        }
        if not wide:
            break
        moved = _narrow(values, by, wide, bracket, estimate)
        if not moved:
            break

    pending = {w: bracket[w] for w in wanted}
    found.update(_pick(values, by, pending))
    missing = [w for w in wanted if w not in found]
    if missing:
        if not start:
            raise ValueError(f"ranks outside the data: {missing[:3]}")
        again: dict = {}
        for g, r in missing:
            again.setdefault(g, []).append(r)
        found.update(select_ranks(df, by, value, again, None, counts, bracket_rows))
    return found


def _slots(pairs: Mapping) -> tuple[dict, dict]:
    """Number the distinct brackets inside each group so equal ones are read once."""
    slot_of, brackets, used = {}, {}, {}
    for (g, r), b in pairs.items():
        seen = used.setdefault(g, {})
        slot = seen.setdefault(b, len(seen))
        slot_of[(g, r)] = slot
        brackets[(g, slot)] = b
    return slot_of, brackets


def _narrow(values: DataFrame, by: list[str], wide: Mapping, bracket: dict, estimate: dict) -> bool:
    slot_of, brackets = _slots(wide)
    low = F.col("__lo").isNotNull() & (F.col("__v") < F.col("__lo"))
    grid = [i / GRID for i in range(GRID + 1)]
    rows = (
        _with_brackets(values, by, brackets)
        .groupBy(*by, "__slot")
        .agg(
            F.count(F.when(low, F.lit(1))).alias("below"),
            F.count(F.when(~low, F.lit(1))).alias("inside"),
            sketch("CASE WHEN __lo IS NULL OR __v >= __lo THEN __v END", grid, SKETCH_ACCURACY).alias("grid"),
        )
        .collect()
    )
    stats = {(tuple(r[c] for c in by), r["__slot"]): r for r in rows}
    moved = False
    for (g, rank), old in wide.items():
        row = stats.get((g, slot_of[(g, rank)]))
        if row is None or not row["inside"]:
            raise ValueError(f"rank {rank} is outside group {g}")
        inside, rel = row["inside"], rank - row["below"]
        estimate[(g, rank)] = inside
        if inside <= 1 or not 0 <= rel < inside:
            continue
        lo_at = max(math.floor(rel / inside * GRID) - _MARGIN, 0)
        hi_at = min(math.ceil((rel + 1) / inside * GRID) + _MARGIN, GRID)
        new = (row["grid"][lo_at], row["grid"][hi_at])
        new = (old[0] if lo_at == 0 else new[0], old[1] if hi_at == GRID else new[1])
        if new != old:
            bracket[(g, rank)] = new
            estimate[(g, rank)] = inside * (hi_at - lo_at + 1) / GRID
            moved = True
    return moved


def _pick(values: DataFrame, by: list[str], pending: Mapping) -> dict:
    """Count the bracket's distinct values, sum them up in order and read the wanted ranks.

    All rows below a bracket collapse map-side into a single null-valued row.
    """
    if not pending:
        return {}
    spark = values.sparkSession
    slot_of, brackets = _slots(pending)
    inside = F.when(F.col("__lo").isNull() | (F.col("__v") >= F.col("__lo")), F.col("__v"))
    counted = (
        _with_brackets(values, by, brackets)
        .select(*by, "__slot", inside.alias("__v"))
        .groupBy(*by, "__slot", "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    order = Window.partitionBy(*by, "__slot").orderBy(F.col("__v").asc_nulls_first())
    running = counted.withColumn(
        "__end", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    schema = T.StructType(
        [
            *_bracket_schema(values, by),
            T.StructField("__slot", T.IntegerType()),
            T.StructField("__rank", T.LongType()),
        ]
    )
    targets = small_frame(spark, [(*g, slot_of[(g, r)], r) for g, r in pending], schema)
    hits = (
        running.join(targets, [*by, "__slot"])
        .filter(
            F.col("__v").isNotNull()
            & (F.col("__end") > F.col("__rank"))
            & (F.col("__end") - F.col("__n") <= F.col("__rank"))
        )
        .select(*by, "__rank", "__v", "__end", "__n")
        .collect()
    )
    return {
        (tuple(h[c] for c in by), h["__rank"]): (h["__v"], h["__end"] - h["__n"], h["__n"]) for h in hits
    }


def rank_range(n: int, p: float) -> tuple[int, int]:
    """The 0-based ranks that the quantile ``p`` of ``n`` values lies between."""
    return math.floor((n - 1) * p), math.ceil((n - 1) * p)


def interpolated(n: int, p: float, low: float, high: float) -> float:
    return low + (high - low) * ((n - 1) * p - math.floor((n - 1) * p))


def around(probabilities: Sequence[float]) -> list[float]:
    """Fractions on both sides of each probability, two sketch errors away."""
    gap = 2.0 / SKETCH_ACCURACY
    return [f for p in probabilities for f in (max(p - gap, 0.0), min(p + gap, 1.0))]


def quantile_values(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    bracket_rows: int = BRACKET_ROWS,
) -> dict[tuple, list[float | None]]:
    """Linear-interpolated exact quantiles per group, keyed by the group tuple."""
    by = list(by)
    sketched = sketch("__v", around(probabilities), SKETCH_ACCURACY).alias("__grid")
    valued = df.select(*by, F.col(value).cast("double").alias("__v"))
    rows = valued.groupBy(*by).agg(F.count("__v").alias("__size"), sketched).collect()
    counts, ranks, start, inside = {}, {}, {}, {}
    for r in rows:
        g = tuple(r[c] for c in by)
        n = counts[g] = r["__size"]
        for i, p in enumerate(probabilities if n else ()):
            for k in rank_range(n, p):
                ranks.setdefault(g, []).append(k)
                few = n <= min(SMALL_GROUP, bracket_rows)
                start.setdefault((g, k), (None, None) if few else tuple(r["__grid"][2 * i : 2 * i + 2]))
                inside[(g, k)] = n if few else 6 * n / SKETCH_ACCURACY
    picked = select_ranks(df, by, value, ranks, start, counts, bracket_rows, inside)
    return {
        g: [interpolated(n, p, *(picked[(g, k)][0] for k in rank_range(n, p))) if n else None for p in probabilities]
        for g, n in counts.items()
    }


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    extra: Sequence[Column] = (),
    bracket_rows: int = BRACKET_ROWS,
) -> tuple[Row, dict[str, list[float | None]]]:
    """The ``extra`` aggregates of ``df``, and the linear-interpolated exact quantiles of its columns, nulls left out.

    One scan aggregates and sketches all columns, one more counts the values in the brackets; only a bracket that may hold more
    than ``bracket_rows`` rows (beyond some 4 * 10^8 rows of a column) takes further scans to narrow.
    """
    values = [f"cast(`{c}` AS double)" for c in columns]
    found = [x for i, v in enumerate(values) for x in (F.expr(f"count({v})").alias(f"__n_{i}"), sketch(v, around(probabilities), SKETCH_ACCURACY).alias(f"__grid_{i}"))]
    first = df.agg(*extra, *found).first()
    sizes = [first[f"__n_{i}"] for i in range(len(columns))]
    slots = [_Slot(i, p, n, first[f"__grid_{i}"], j, bracket_rows) for i, n in enumerate(sizes) if n for j, p in enumerate(probabilities)]
    for _ in range(_ROUNDS):
        wide = [s for s in slots if s.rows > bracket_rows and not s.settled]
        if not wide:
            break
        _narrow_slots(df, values, wide)
    at = _ranks_of_slots(df, values, slots)
    lost = [k for k, s in enumerate(slots) for r in rank_range(s.n, s.p) if (k, r) not in at]
    if lost:  # a sketch outside its stated error
        for k in lost:
            slots[k].low = slots[k].high = None
        at = _ranks_of_slots(df, values, slots)
    out: dict = {c: [None] * len(probabilities) for c in columns}
    for k, s in enumerate(slots):
        out[columns[s.column]][s.place] = interpolated(s.n, s.p, *(at[(k, r)] for r in rank_range(s.n, s.p)))
    return first, out


class _Slot:
    """The bracket of one quantile of one column; None is no limit."""

    def __init__(self, column: int, p: float, n: int, grid: Sequence[float], place: int, bracket_rows: int):
        self.column, self.p, self.n, self.place, self.settled = column, p, n, place, False
        few = n <= min(SMALL_GROUP, bracket_rows)
        self.low, self.high = (None, None) if few else (grid[2 * place], grid[2 * place + 1])
        self.rows: float = n if few else 6 * n / SKETCH_ACCURACY

    def below(self, v: str) -> str:
        return "false" if self.low is None else f"{v} < double('{self.low!r}')"

    def holds(self, v: str) -> str:
        limits = [f"{v} {op} double('{x!r}')" for op, x in ((">=", self.low), ("<=", self.high)) if x is not None]
        return " AND ".join([f"{v} IS NOT NULL", *limits])


def _narrow_slots(df: DataFrame, values: Sequence[str], wide: Sequence[_Slot]) -> None:
    """One scan: a finer sketch inside each bracket."""
    grid = [i / GRID for i in range(GRID + 1)]
    aggs = []
    for k, s in enumerate(wide):
        v = values[s.column]
        aggs += [F.expr(f"count_if({s.below(v)})").alias(f"below_{k}"), F.expr(f"count_if({s.holds(v)})").alias(f"inside_{k}")]
        aggs.append(sketch(f"CASE WHEN {s.holds(v)} THEN {v} END", grid, SKETCH_ACCURACY).alias(f"grid_{k}"))
    row = df.agg(*aggs).first()
    for k, s in enumerate(wide):
        first, last = (r - row[f"below_{k}"] for r in rank_range(s.n, s.p))
        inside = row[f"inside_{k}"]
        s.rows, s.settled = inside, True
        if 0 <= first and last < inside:
            lo_at = max(math.floor(first / inside * GRID) - _MARGIN, 0)
            hi_at = min(math.ceil((last + 1) / inside * GRID) + _MARGIN, GRID)
            new = (row[f"grid_{k}"][lo_at], row[f"grid_{k}"][hi_at])
            s.settled = new == (s.low, s.high)  # one hot value: nothing narrower, and few distinct values
            s.low, s.high = new
            s.rows = inside * (hi_at - lo_at + 1) / GRID


def _ranks_of_slots(df: DataFrame, values: Sequence[str], slots: Sequence[_Slot]) -> dict[tuple[int, int], float]:
    """{(slot, rank): value}. One scan: each Arrow batch becomes a count of what lies below each bracket and the distinct values
    inside it with their counts; these few rows are summed up and ranked."""
    if not slots:
        return {}
    ship(df.sparkSession)
    brackets = [(k, s.column, s.low, s.high) for k, s in enumerate(slots)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.drop_null().to_numpy() for c in batch.columns]
            out: list[tuple[np.ndarray, ...]] = []
            for k, column, low, high in brackets:
                below, distinct, n = counted_in(columns[column], low, high)
                out.append((np.full(len(n), k), distinct, n, np.zeros(len(n), bool)))
                out.append((np.array([k]), np.zeros(1), np.array([below]), np.ones(1, bool)))
            slot, v, n, under = (np.concatenate(x) for x in zip(*out))
            columns_out = [pa.array(slot.astype(np.int32)), pa.array(v, mask=under), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns_out, ["slot", "v", "n"])

    rows = df.selectExpr(*[f"{v} AS __v_{i}" for i, v in enumerate(values)]).mapInArrow(run, "slot int, v double, n long")
    counted = rows.groupBy("slot", "v").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("slot").orderBy(F.col("v").asc_nulls_first())
    running = counted.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("rank", T.LongType())])
    wanted = sorted({(k, r) for k, s in enumerate(slots) for r in rank_range(s.n, s.p)})
    hits = running.join(small_frame(df.sparkSession, wanted, schema), "slot").where("v IS NOT NULL AND end > rank AND end - n <= rank")
    return {(h["slot"], h["rank"]): h["v"] for h in hits.collect()}


def counted_in(v: np.ndarray, low: float | None, high: float | None) -> tuple[int, np.ndarray, np.ndarray]:
    """How many values lie below the bracket, and its distinct values with their counts. NaN is the largest value."""
    nan = np.isnan(v)
    below = np.zeros(len(v), bool) if low is None else ~nan if math.isnan(low) else v < low
    inside = ~below if high is None or math.isnan(high) else ~below & (v <= high)
    distinct, n = np.unique(v[inside], return_counts=True)
    return int(below.sum()), distinct, n


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    named: Mapping[str, float],
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Frame with one row per group and one column per named quantile."""
    by = list(by)
    found = quantile_values(df, by, value, list(named.values()), bracket_rows)
    schema = T.StructType(
        [*[T.StructField(c, df.schema[c].dataType) for c in by], *[T.StructField(c, T.DoubleType()) for c in named]]
    )
    return small_frame(df.sparkSession, [(*g, *vals) for g, vals in found.items()], schema)

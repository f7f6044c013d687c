"""Scalar functions over a class-probability array.

``k`` is the number of classes when the caller knows it. Up to ``MAX_UNROLL`` classes are
written out as plain arithmetic, which keeps the stage inside whole-stage code generation;
otherwise the same formula is expressed with higher-order functions. Either way an array of
another length than ``k`` fails the query: no class is left out or added.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_UNROLL = 32

# Probability clip used before a logarithm.
PROBABILITY_FLOOR = 1e-10


def _unrolled(k: int | None) -> bool:
    return k is not None and 0 < k <= MAX_UNROLL


def _checked(p: Column, k: int | None, value: Column, kind: str) -> Column:
    """``value`` where the array has ``k`` entries, null where it is null; any other length is an error."""
    if k is None:
        return value
    wrong = F.raise_error(F.concat(F.lit(f"expected {k} classes, found "), F.size(p).cast("string")))
    return F.when(F.size(p) == k, value).when(p.isNotNull(), wrong.cast(kind))


def fold(p: Column, k: int | None, term) -> Column:
    """Sum of ``term(value, index)`` over the array."""
    if _unrolled(k):
        total = reduce(add, [term(F.get(p, F.lit(i)), F.lit(i)) for i in range(k)])
    else:
        total = F.aggregate(F.transform(p, term), F.lit(0.0), lambda acc, x: acc + x)
    return _checked(p, k, total, "double")


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(PROBABILITY_FLOOR)), F.lit(1.0))


def confidence(p: Column) -> Column:
    """Largest class probability."""
    return F.array_max(p)


def argmax(p: Column) -> Column:
    """Index of the largest probability, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - F.lit(1)).cast("int")


def entropy(p: Column, k: int | None = None) -> Column:
    """Shannon entropy in nats of the clipped probabilities."""
    return -fold(p, k, lambda x, i: clipped(x) * F.ln(clipped(x)))


def squared_error(p: Column, y: Column, k: int | None = None) -> Column:
    """Squared distance to the one-hot label; a label outside 0..k-1 is all zero."""

    def term(x: Column, i: Column) -> Column:
        gap = x - F.when(y == i, F.lit(1.0)).otherwise(F.lit(0.0))
        return gap * gap

    return fold(p, k, term)


def tempered(p: Column, temperature: Column, k: int | None = None) -> Column:
    """Probabilities rescaled by softmax(ln(p) / T)."""
    if _unrolled(k):
        top = F.ln(clipped(F.array_max(p))) / temperature
        exps = [F.exp(F.ln(clipped(F.get(p, F.lit(i)))) / temperature - top) for i in range(k)]
        total = reduce(add, exps)
        return _checked(p, k, F.array(*[e / total for e in exps]), "array<double>")
    top = F.ln(clipped(F.array_max(p))) / temperature
    exps = F.transform(p, lambda x: F.exp(F.ln(clipped(x)) / temperature - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return _checked(p, k, F.transform(exps, lambda e: e / total), "array<double>")


def tempered_confidence(log_gap: Column, temperature: Column, k: int | None = None) -> Column:
    """Largest tempered probability from ``log_gap`` = ln(p_i) - ln(max p).

    Dividing by T keeps the order of the classes, so only the top probability changes.
    """
    return F.lit(1.0) / fold(log_gap, k, lambda x, i: F.exp(x / temperature))


def log_gaps(p: Column, k: int | None = None) -> Column:
    top = F.ln(clipped(F.array_max(p)))
    if _unrolled(k):
        return _checked(p, k, F.array(*[F.ln(clipped(F.get(p, F.lit(i)))) - top for i in range(k)]), "array<double>")
    return _checked(p, k, F.transform(p, lambda x: F.ln(clipped(x)) - top), "array<double>")


def softmax(logits: list[Column]) -> Column:
    """Probability array from a fixed list of logit columns."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    exps = [F.exp(z - top) for z in logits]
    total = reduce(add, exps)
    return F.array(*[e / total for e in exps])

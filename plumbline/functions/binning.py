"""Equal-width probability bins on [0, 1] with the exact double edges of ``linspace``."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_UNROLL = 64


def edges(n_bins: int) -> list[float]:
    return [float(e) for e in np.linspace(0, 1, n_bins + 1)]


def bin_index(x: Column, n_bins: int) -> Column:
    """Number of interior edges <= x: left-closed bins, 1.0 in the last one.

    ``floor(x * n)`` is not the same function: 0.3 falls below the third double edge.
    """
    interior = edges(n_bins)[1:-1]
    if not interior:
        return F.lit(0)
    if len(interior) <= MAX_UNROLL:
        return reduce(add, [(x >= F.lit(e)).cast("int") for e in interior])
    return F.size(F.filter(F.array(*[F.lit(e) for e in interior]), lambda e: e <= x))


def edge_at(i: Column, n_bins: int) -> Column:
    """Edge number ``i`` as a lookup in the fixed edge list."""
    return F.get(F.array(*[F.lit(e) for e in edges(n_bins)]), i)


def width_index(x: Column, lo: float, hi: float, n_bins: int) -> Column:
    """Histogram slot of fixed width over [lo, hi], clipped to 0..n-1."""
    slot = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / n_bins)).cast("int")
    return F.least(F.greatest(slot, F.lit(0)), F.lit(n_bins - 1))

"""Exact-size random selection as a filter, with no shuffle of rows.

Rows are ordered by a keyed digest. Taking exactly ``k`` rows means finding the k-th smallest
digest value, so a selection is a literal cut-off: two small aggregates find it, and applying
it is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order_stats import select_ranks


@dataclass(frozen=True)
class Cut:
    """The first ``k`` rows in (value, key) order: below ``value``, or equal to it with a kept key.

    ``keys`` is None when every row equal to ``value`` belongs to the selection.
    """

    value: float
    keys: tuple[str, ...] | None = field(default=None)

    def contains(self, value: Column, key: Column) -> Column:
        if self.keys is None:
            return value <= F.lit(self.value)
        return (value < F.lit(self.value)) | (
            (value == F.lit(self.value)) & key.cast("string").isin(*self.keys)
        )


NOTHING = Cut(-1.0)
EVERYTHING = Cut(2.0)


def uniform_bracket(rank: int, n: int) -> tuple[float, float]:
    """Where the value of a rank lies among ``n`` uniform draws, eight deviations wide."""
    spread = 8.0 * math.sqrt(n) + 8.0
    return max((rank - spread) / n, 0.0), min((rank + spread) / n, 1.0)


def cuts(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    key: str,
    takes: Mapping[tuple, Sequence[int]],
    sizes: Mapping[tuple, int],
) -> dict[tuple[tuple, int], Cut]:
    """{(group, k): Cut} selecting exactly ``k`` rows of the group, for every k asked.

    ``value`` must be uniform on [0, 1); rows are ordered by (value, key).
    """
    out: dict = {}
    ranks: dict = {}
    start: dict = {}
    for g, ks in takes.items():
        for k in dict.fromkeys(ks):
            if k <= 0:
                out[(g, k)] = NOTHING
            elif k >= sizes[g]:
                out[(g, k)] = EVERYTHING
            else:
                ranks.setdefault(g, []).append(k - 1)
                start[(g, k - 1)] = uniform_bracket(k - 1, sizes[g])
    for (g, rank), (at, below, equal) in select_ranks(df, by, value, ranks, start, sizes).items():
        keys = None
        if below + equal != rank + 1:
            keys = _tied_keys(df, by, value, key, g, at, rank + 1 - below)
        out[(g, rank + 1)] = Cut(at, keys)
    return out


def _tied_keys(df, by, value, key, group, at, needed) -> tuple[str, ...]:
    """Keys of the rows sharing the cut-off value; digests collide for a handful of rows at most."""
    same = F.col(value) == F.lit(at)
    for c, v in zip(by, group):
        same = same & (F.col(c) == F.lit(v))
    rows = df.filter(same).orderBy(key).limit(needed).select(F.col(key).cast("string")).collect()
    return tuple(r[0] for r in rows)

"""Rounding of exact decimal ties.

``round`` works on the shortest decimal form of a double, so 86.115 becomes 86.12 although the
double lies just below the tie. Scores are sums of three-digit points, where such ties are
common; here the double's true value decides, and a true tie goes to the even digit.
"""

from __future__ import annotations

_SPLIT = "134217729e0"


def nearest(x: str, digits: int) -> str:
    """SQL text rounding the column ``x``; valid in Spark and in ANSI engines.

    2 * 10^digits * x is formed as product plus exact error (the column split into halves of 26
    bits), which tells on which side of an odd integer, that is of a tie, the value lies.
    """
    scale = f"{2 * 10**digits}e0"
    p = f"({x} * {scale})"
    hi = f"({x} * {_SPLIT} - ({x} * {_SPLIT} - {x}))"
    error = f"(({hi} * {scale} - {p}) + ({x} - {hi}) * {scale})"
    down, up = f"(({p} - 1e0) / 2e0)", f"(({p} + 1e0) / 2e0)"
    return f"""((CASE WHEN {p} = floor({p}) AND abs({p} % 2e0) = 1e0 THEN
      CASE WHEN {error} < 0e0 THEN {down} WHEN {error} > 0e0 THEN {up}
           WHEN {down} % 2e0 = 0e0 THEN {down} ELSE {up} END
    ELSE floor({up}) END) / {10**digits}e0)"""

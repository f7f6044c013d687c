"""Reproducible random numbers derived from a row key.

``rand(seed)`` depends on how rows are laid out in partitions; a digest of (seed, tag, key)
does not, so a lost executor or another partition count gives the same draws.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = float(2**32)
LONG_WORD = float(2**52)
UNIFORMS_PER_DIGEST = 4


def digest(seed: int, tag: Column | str, part: Column | str, key: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    part = F.lit(part) if isinstance(part, str) else part
    return F.md5(F.concat_ws("|", F.lit(str(seed)), tag, part, key.cast("string")))


def uniform(dig: Column, slot: int) -> Column:
    """Uniform in (0, 1) from one of the four 32-bit words of a digest, centred in its cell."""
    word = F.conv(F.substring(dig, 8 * slot + 1, 8), 16, 10).cast("double")
    return (word + F.lit(0.5)) / F.lit(WORD)


def ordering(dig: Column) -> Column:
    """Uniform on [0, 1) with 52 random bits, used where rows are ranked."""
    return F.conv(F.substring(dig, 1, 13), 16, 10).cast("double") / F.lit(LONG_WORD)


# Many draws per row come from one digest: its words are mixed by random linear maps modulo the
# Mersenne prime 2^31 - 1, which costs a few integer multiplications per draw. Draws under
# different labels are pairwise independent because the label coefficients are; a power of each then
# makes the many draws of a wide row look independent too.
#
# These builders return SQL text: a suite needs hundreds of small operations, and one parsed
# expression is far cheaper to set up than a tree of Column calls.

PRIME = 2**31 - 1
WORDS = 4
_WORD_DIGITS = 7
_COEFFICIENT_BITS = 29
_FINE = 2**21


def row_digest(seed: int, key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', cast(`{key}` AS string)))"


def word(dig: str, i: int) -> str:
    """One of four 28-bit integers of a row, never null, which keeps the generated code short."""
    return f"coalesce(cast(conv(substring({dig}, {_WORD_DIGITS * i + 1}, {_WORD_DIGITS}), 16, 10) AS bigint), 0L)"


def coefficients(*label: object) -> list[int]:
    """Four non-zero integers below 2^29 derived from a label."""
    hexed = hashlib.md5("|".join(str(part) for part in label).encode()).hexdigest()
    return [int(hexed[8 * i : 8 * i + 8], 16) % (2**_COEFFICIENT_BITS - 1) + 1 for i in range(WORDS)]


def mix(terms: list[str], by: list[int] | list[str]) -> str:
    """Dot product modulo the prime of columns with constants or further columns.

    Integers below 2^31 times coefficients below 2^29 fit 64 bits.
    """
    factors = [f"{c}L" if isinstance(c, int) else c for c in by]
    return "((" + " + ".join(f"{t} * {c}" for t, c in zip(terms, factors)) + f") % {PRIME}L)"


def line(terms: list[str], *label: object) -> str:
    """Integer in 0..PRIME-1 for one label: a linear map, so any five of a row are linearly dependent."""
    return mix(terms, coefficients(*label))


def bent(drawn: str) -> str:
    """The fifth power modulo the prime: a permutation of 0..PRIME-1 (5 doesn't divide PRIME - 1) that takes the linear
    dependence out of many draws of one row. ``drawn`` is a column, as it is named several times."""
    square = f"(({drawn} * {drawn}) % {PRIME}L)"
    return f"(((({square} * {square}) % {PRIME}L) * {drawn}) % {PRIME}L)"


def open_uniform(drawn: str) -> str:
    """Uniform in (0, 1), centred in its cell."""
    return f"((cast({drawn} AS double) + 0.5D) / {float(PRIME)!r}D)"


def fine_uniform(high: str, low: str) -> str:
    """Uniform on [0, 1) with 52 bits from two draws, used where rows are ranked."""
    return f"((cast({high} AS double) * {float(_FINE)!r}D + cast({low} % {_FINE}L AS double)) / {LONG_WORD!r}D)"


def normal(u1: str, u2: str) -> str:
    """Standard normal by the Box-Muller transform."""
    return f"(sqrt(-2.0D * ln({u1})) * cos({2.0 * math.pi!r}D * {u2}))"


def driver_uniform(*label: object) -> float:
    """A uniform on the driver, for decisions made once per column."""
    return (coefficients(*label)[0] - 0.5) / (2**_COEFFICIENT_BITS - 1)


# The same draws for a whole matrix at once, bit for bit.


def fifth_powers(drawn: np.ndarray) -> np.ndarray:
    square = drawn * drawn % PRIME
    return square * square % PRIME * drawn % PRIME


def open_uniforms(drawn: np.ndarray) -> np.ndarray:
    return (drawn + 0.5) / float(PRIME)


def fine_uniforms(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high * float(_FINE) + low % _FINE) / LONG_WORD


def normals(u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * math.pi * u2)

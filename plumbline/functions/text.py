"""Number formats used by the display tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int, suffix: str = "") -> Column:
    """Fixed decimals; a negative value that rounds to zero keeps its sign, as ``-0.0``."""
    near = F.round(x, digits)
    shown = F.format_string(f"%.{digits}f{suffix.replace('%', '%%')}", near)
    return F.when((x < 0) & (near == 0), F.concat(F.lit("-"), shown)).when(x.isNotNull(), shown)


def percent(x: Column, digits: int) -> Column:
    """A fraction shown as a percentage."""
    return fixed(x * F.lit(100.0), digits, "%")


def quoted(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def lookup(values: list[str], index: str) -> Column:
    """Element of a constant string list by a zero-based index column."""
    return F.expr(f"get(array({', '.join(quoted(v) for v in values)}), {index})")

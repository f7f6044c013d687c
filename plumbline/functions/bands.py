"""Threshold labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label thresholds.
SEVERITY_BELOW = [(5.0, "Low"), (15.0, "Medium"), (30.0, "High")]
SEVERITY_ELSE = "Critical"
QUALITY_BELOW = [(0.03, "Excellent"), (0.07, "Good"), (0.15, "Moderate")]
QUALITY_ELSE = "Poor"
CATEGORY_BELOW = [(10.0, "High"), (20.0, "Medium")]
CATEGORY_ELSE = "Low"
SCORE_FROM = [(80.0, "Excellent"), (60.0, "Good"), (40.0, "Moderate")]
SCORE_ELSE = "Low"
RATING_FROM = [(70.0, "High"), (40.0, "Medium")]
RATING_ELSE = "Low"
GRADE_FROM = [(90.0, "A+"), (80.0, "A"), (70.0, "B"), (60.0, "C"), (50.0, "D")]
GRADE_ELSE = "F"
GRADE_COLOUR = {
    "A+": "#2ECC71",
    "A": "#27AE60",
    "B": "#F39C12",
    "C": "#E67E22",
    "D": "#E74C3C",
    "F": "#C0392B",
}


def below(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose limit lies above ``x``."""
    chain = F
    for limit, label in steps:
        chain = chain.when(x < F.lit(limit), F.lit(label))
    return F.when(x.isNotNull(), chain.otherwise(F.lit(otherwise)))


def at_least(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose limit is reached by ``x``."""
    chain = F
    for limit, label in steps:
        chain = chain.when(x >= F.lit(limit), F.lit(label))
    return F.when(x.isNotNull(), chain.otherwise(F.lit(otherwise)))


def severity(drop_pct: Column) -> Column:
    return below(drop_pct, SEVERITY_BELOW, SEVERITY_ELSE)


def calibration_quality(ece: Column) -> Column:
    return below(ece, QUALITY_BELOW, QUALITY_ELSE)


def category_robustness(mean_drop_pct: Column) -> Column:
    return below(mean_drop_pct, CATEGORY_BELOW, CATEGORY_ELSE)


def score_band(score: Column) -> Column:
    return at_least(score, SCORE_FROM, SCORE_ELSE)


def rating(score: Column) -> Column:
    return at_least(score, RATING_FROM, RATING_ELSE)


def grade(total: Column) -> Column:
    return at_least(total, GRADE_FROM, GRADE_ELSE)


def grade_colour(letter: Column) -> Column:
    chain = F
    for name, colour in GRADE_COLOUR.items():
        chain = chain.when(letter == F.lit(name), F.lit(colour))
    return chain

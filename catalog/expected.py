"""Labels as the check SQL writes them: limits and names are stated here again, so that a wrong one in the library shows."""

from __future__ import annotations


def severity(x: str) -> str:
    return f"CASE WHEN {x} < 5e0 THEN 'Low' WHEN {x} < 15e0 THEN 'Medium' WHEN {x} < 30e0 THEN 'High' ELSE 'Critical' END"


def quality(x: str) -> str:
    return f"CASE WHEN {x} < 0.03e0 THEN 'Excellent' WHEN {x} < 0.07e0 THEN 'Good' WHEN {x} < 0.15e0 THEN 'Moderate' ELSE 'Poor' END"


def category(x: str) -> str:
    return f"CASE WHEN {x} < 10e0 THEN 'High' WHEN {x} < 20e0 THEN 'Medium' ELSE 'Low' END"


def score_band(x: str) -> str:
    return f"CASE WHEN {x} >= 80e0 THEN 'Excellent' WHEN {x} >= 60e0 THEN 'Good' WHEN {x} >= 40e0 THEN 'Moderate' ELSE 'Low' END"


def rating(x: str) -> str:
    return f"CASE WHEN {x} >= 70e0 THEN 'High' WHEN {x} >= 40e0 THEN 'Medium' ELSE 'Low' END"


def grade(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 90e0 THEN 'A+' WHEN {x} >= 80e0 THEN 'A' WHEN {x} >= 70e0 THEN 'B' "
        f"WHEN {x} >= 60e0 THEN 'C' WHEN {x} >= 50e0 THEN 'D' ELSE 'F' END"
    )


def grade_colour(x: str) -> str:
    return (
        f"CASE {x} WHEN 'A+' THEN '#2ECC71' WHEN 'A' THEN '#27AE60' WHEN 'B' THEN '#F39C12' "
        "WHEN 'C' THEN '#E67E22' WHEN 'D' THEN '#E74C3C' WHEN 'F' THEN '#C0392B' END"
    )

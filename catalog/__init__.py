"""Registered queries: each pairs a Spark plan with an independent SQL statement for checking."""

from __future__ import annotations

from importlib import import_module

from .base import REGISTRY

SECTIONS = (
    "profiling",
    "cleaning",
    "preparation",
    "training",
    "evaluation",
    "confidence",
    "stressing",
    "robustness",
    "calibrating",
    "comparing",
    "reliability",
    "reporting",
    "exports",
)


def load():
    for section in SECTIONS:
        import_module(f"catalog.{section}")
    return dict(REGISTRY)

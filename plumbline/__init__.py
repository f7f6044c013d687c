"""Classifier trust metrics as Spark DataFrame transformations.

Every operator takes and returns DataFrames and is grouped by key columns
(``model``, ``split`` by default), so one model or a thousand is the same plan.
"""

__version__ = "0.1.0"

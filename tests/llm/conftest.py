import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plain import edited, prose  # noqa: E402

SHARED_LINE = "  This line is in MANY documents, é and all. "


@pytest.fixture(scope="session")
def rows():
    """(id, text) with nulls, blanks, copies, near copies, shared passages and lines, a long text and repeated rows."""
    passage = prose(60, 99)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (None, prose(80, 1)), (None, None)]
    base = prose(120, 2)
    out += [(10 + i, base) for i in range(6)] + [(20 + i, edited(base, 0.02, i)) for i in range(8)]
    out += [(30 + i, f"{prose(70, 30 + i)} {passage} {prose(40, 60 + i)}") for i in range(6)]
    out += [(50 + i, f"{prose(40, 80 + i)}\n{SHARED_LINE}\n{prose(30, 90 + i, 'äöüß日本')}\n\n{SHARED_LINE.lower()}") for i in range(5)]
    out += [(70, prose(30_000, 7)), (71, " ".join(["same words again"] * 200)), (72, "a" * 500), (10, base), (71, " ".join(["same words again"] * 200))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those of the results; spread over partitions."""
    df = spark.createDataFrame([(d, t, "x", i, "k") for i, (d, t) in enumerate(rows)], "doc_id long, text string, kept string, n_words int, _row string")
    return df.repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where(F.lit(False))

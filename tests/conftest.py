import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    """Ten predictions over three classes with known measures."""
    rows = [
        (0, 0, [0.90, 0.05, 0.05], 0),
        (1, 0, [0.60, 0.30, 0.10], 0),
        (2, 1, [0.30, 0.40, 0.30], 1),
        (3, 2, [0.20, 0.70, 0.10], 1),
        (4, 2, [0.10, 0.10, 0.80], 2),
        (5, 1, [0.85, 0.10, 0.05], 0),
        (6, 1, [0.05, 0.95, 0.00], 1),
        (7, 1, [0.40, 0.40, 0.20], 0),
        (8, 2, [0.10, 0.20, 0.70], 2),
        (9, 2, [0.00, 0.00, 1.00], 2),
    ]
    return spark.createDataFrame(
        [("m", 0, "test", i, y, p, proba) for i, y, proba, p in rows],
        "model string, model_seq int, split string, row_id long, y_true int, y_pred int, proba array<double>",
    )


@pytest.fixture(scope="session")
def stress_table(spark):
    """Five stress results of one model with known scores."""
    rows = [
        ("Gaussian Noise (Low)", 0.90, 0.88, 0.97, 0.88),
        ("Feature Dropout (30%)", 0.90, 0.60, 0.65, 0.58),
        ("Corruption (5%, zero)", 0.90, 0.85, 0.93, 0.85),
        ("Scale Perturbation (2.0x)", 0.90, 0.70, 0.74, 0.69),
        ("Mean Shift (1.0)", 0.90, 0.92, 0.90, 0.92),
    ]
    return spark.createDataFrame(
        [
            ("m", 0, "test", i, name, a, b, a - b, (a - b) / a * 100, b, b, f1, agree)
            for i, (name, a, b, agree, f1) in enumerate(rows)
        ],
        "model string, model_seq int, split string, test_seq int, test_name string, accuracy_original double, "
        "accuracy_stressed double, performance_drop double, performance_drop_pct double, precision_stressed double, "
        "recall_stressed double, f1_stressed double, prediction_agreement double",
    )

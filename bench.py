"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINE = (
    "p10_column_info",
    "p12_describe",
    "c2_fill_in_order",
    "c7_forward_fill",
    "f1_label_encode",
    "f4_split_stratified",
    "f7_prepare",
    "m11_classification_report",
    "q13_confidence_by_class",
    "k1_calibration_metrics",
    "k6_optimal_temperature",
    "t8_batch_stress_test",
    "v10_recommendations",
    "d7_ranking_table",
    "r7_score_all_models",
    "s13_export_all_sections",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    known = catalog.load()
    known["k1_calibration_metrics"].run(spark, sf_dir).collect()  # start the JVM's code paths
    times = {}
    for name in HEADLINE:
        started = time.time()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    folder = os.path.basename(os.path.normpath(sf_dir))
    sf = float(folder[2:]) if folder.startswith("sf") else folder
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

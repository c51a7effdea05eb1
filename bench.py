"""Headline queries, timed: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names). Each query is run in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "window_boundaries", "window_features", "features_all", "spectral_features", "augmented_windows",
    "detection_windows", "prediction_windows", "resample_half", "stationary_segments", "calibrate_subjects",
    "rotate_samples", "bandpass", "validate_trials", "sisfall_lines", "label_lookup", "subject_split",
    "class_weights", "trial_batches", "roc_auc", "class_report", "focal_loss", "lead_time_summary",
    "errors_by_distance", "smooth_alerts", "state_changes", "impact_peaks", "batch_scoring", "live_scores",
]


def main() -> None:
    from kinelake.queries import QUERIES
    from kinelake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()

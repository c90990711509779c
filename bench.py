"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from framelane import session
from framelane.plans import catalog

HEADLINE = [
    "video_summary",
    "success_curve",
    "detection_counts",
    "dedup_most_confident",
    "fill_gaps",
    "repair_query_frames",
    "rolling_window",
    "low_score_runs",
    "savgol",
    "hampel_pass",
    "two_scale_hampel",
    "confidence_estimate",
    "motion_features",
    "trajectory_quality",
    "roc_auc",
    "brier_decomposition",
    "modality_triples",
    "score_correlation",
    "grey_cooccurrence",
    "dataset_cube",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        f"local[{cpus}]", app="bench", partitions=max(8, int(cpus) if cpus.isdigit() else 8),
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    session.release_cuts(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

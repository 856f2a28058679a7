"""Time the headline queries (better of two runs each) and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from landpulse.plans import load  # noqa: E402
from landpulse.session import local_session  # noqa: E402

HEADLINE = [
    "n18_duration_distribution", "n13_acquisition_cycles", "n08_project_snapshots", "n02_project_timeline", "f03_feature_assembly",
    "t01_clean_text", "e11_link_inventory", "q02_column_profile", "q11_survey_checks", "a04_numeric_signal", "m05_project_split", "m12_ranking_metrics",
    "m19_calibration_error", "x03_global_importance", "r14_recommended_actions", "r17_projects_by_state", "r21_state_risk_matrix", "r28_state_queues",
]

# Dear ones, timed once each, as they come.
MORE = [
    "a07_spearman_matrix", "e01_project_details", "e03_notification_rows", "e08_survey_rows", "e09_party_rows", "f08_project_master",
    "m09_logistic_regression", "m15_prior_predictions", "m17_isotonic_calibrator", "x05_decile_table", "f06_wide_project_record",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")), "landpulse-bench")
    queries = load()[0]
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the executor threads
    seconds, first, more = {}, {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name], first[name] = round(min(runs), 3), round(runs[0], 3)
    for name in MORE:
        if name in queries:
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            more[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "first_run": first, "more": more, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

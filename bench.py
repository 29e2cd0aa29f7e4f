"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local cores. Each
query runs once to warm up and then BENCH_RUNS times (default 1); the best run
counts. Results go to the noop sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallywise.plans import load
from tallywise.session import build_session

HEADLINE = [
    "review_summary", "raw_to_review_queue", "j01_bank_money", "j04_lenient_date", "j10_parse_name",
    "c01_household_transform", "c14_accounting_projection", "d04_keep_frequent", "d22_validation_report",
    "e01_apply_corrections", "e07_audit", "f02_confidence_stats", "f06_dataset_summary", "f11_class_report",
    "f13_roc_auc", "f14_pr_auc", "g01_running_balance", "g03_latest_versions", "a02_normalise_statement",
    "d16_file_verdict", "b01_stage_write", "k01_tfidf_word", "k02_tfidf_char", "k05_stratified_split",
    "k10_merge_corrections", "k08_predict", "l01_file_drop_ingest", "l02_daily_quality_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = sys.argv[1:]
    cores = 8 if cpus == "*" else int(cpus)
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=2 * cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    run = lambda n: queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        run(name)
        best = None
        for _ in range(runs):
            t = time.perf_counter()
            run(name)
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

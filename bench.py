"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

QUERIES = [
    "coerce_numeric", "dup_stats", "label_conflicts", "column_inventory", "corr_pairs", "window_agg_policy", "segment_gap",
    "sequences_sliding", "join_offset_h", "growth_baseline", "fit_impute_scale", "transform_frozen", "sessionize_flows", "flow_features_65",
    "join_interval_match", "roc_auc", "calibration_bins", "trajectory_stats", "regression_extended", "stage_rules", "triage_level",
    "abs_rel_diff", "scan_pcap", "leakage_checks", "train_forecaster", "rollout_k", "train_logreg", "stream_flows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from flowloom.plans import catalog
    from flowloom.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["segment_gap"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in only or QUERIES:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = Path(sf_dir).name.replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

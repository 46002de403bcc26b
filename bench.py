"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from vecloom.plans import catalogue
from vecloom.session import local_session

HEADLINE = (
    "vec_knn_cosine", "vec_knn_l2", "knn_batch", "knn_tag_filter_all", "merge_topk_shards", "knn_segmented", "lww_then_knn", "lww_visible", "compact_full", "size_tier_pick",
    "tag_inverted_index", "hist_cumulative", "latency_percentiles", "agreement_rollup", "quota_admission", "qps_admission", "ring_replicas_rf3", "rebalance_remove", "phi_accrual", "ann_ivf_recall",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="12g", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalogue.queries(), {}
    for name in HEADLINE:
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles code and warms the file cache
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None, "lww_rows_per_sec": round(events / took["lww_visible"])}))


if __name__ == "__main__":
    main()

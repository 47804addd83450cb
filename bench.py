"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from spanframe.plans import catalog
from spanframe.session import local_session

HEADLINE = (
    "d1_normalize", "d2_intersect", "d7_points_in", "d11_tile_overlap", "d12_map_intervals", "d21_literal_spans", "e2_tile_entropy",
    "e4_hashed_bigram_features", "f2_select_topk", "f11_evidence_by_selector", "i2_bootstrap_mean", "i3_paired_bootstrap", "i6_kendall_tau_b",
    "b10_promote_reserves", "c1_exact_dedup", "c3_component_dedup", "c16_collapse_runs", "g3_tile_recall", "h3_deletion_auc", "j4_probability_metrics",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

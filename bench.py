"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from millrace.plans import catalogue
from millrace.session import local_session

HEADLINE = [
    "flagship_summary", "agg_mean_by_flag", "agg_sumsq", "quantile_linear", "quantile_lower", "histogram_10", "topk_largest", "topk_per_group",
    "rank_average", "search_sorted", "sigmoid", "softmax_by_group", "nearest_euclidean", "classification", "roc_curve", "auc", "standard_scale",
    "pipeline_scale", "chunk_window_mean", "tree_predict", "bagging_predict", "forest_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    catalogue.QUERIES["agg_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

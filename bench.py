"""Times the headline queries (the median of three warm runs, and the cold one); prints one JSON line."""

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = [
    "growth_forecast_linear", "summary_multi_left_join", "price_comparison_status", "asof_next_observation", "latest_per_key", "top_n_per_group", "snapshot_diff", "rolling_features", "exp_smoothing_forecast",
    "percentile_linear", "shared_category_pairs", "upper_median_outliers", "composite_score_10d", "cosine_top_k", "keyword_search", "content_hash_dedup",
]


def main() -> None:
    from marketspark.plans.catalog import QUERIES
    from marketspark.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took, cold = {}, {}
    for name in [n for n in HEADLINE if n in QUERIES]:
        runs = []
        for _ in range(4):  # cold, then three warm ones
            t = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        cold[name], took[name] = round(runs[0], 3), round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

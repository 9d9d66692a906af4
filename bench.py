"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local threads. Each query is computed in
full through the no-op sink, BENCH_REPEATS times (default 3, once after BENCH_SECONDS in all), and its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "curate_validate_reject", "curate_fingerprint_dedup", "curate_latest_wins", "text_item_list", "page_fields",
    "label_upsert_latest", "bag_long", "line_detail_join", "feat_structure", "feat_curve", "feature_wide",
    "quality_report", "eda_summary", "div_crosstab", "div_by_quintile", "prep_impute_cap", "prep_tfidf",
    "folds_stratified", "folds_inner", "folds_group", "knn_exact", "metrics_fold", "vote_mean_f1", "majority_repeat",
    "agree_triadic", "friedman", "wilcoxon", "lift_by_class", "means_divergent", "stream_dedup", "nb_gaussian",
    "nb_multinomial",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats, limit = int(os.environ.get("BENCH_REPEATS", "3")), float(os.environ.get("BENCH_SECONDS", "900"))
    from basketwise.plans import catalogue
    from basketwise.session import local_session, release

    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start-up
    began, times = time.time(), {}
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < (repeats if time.time() - began < limit else 1):
            start = time.time()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
            release(spark)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
